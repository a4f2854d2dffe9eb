import math
import random

import numpy as np
import pyarrow as pa
import pytest

from chunkloom.llm import language as la


def slow_phrases(text, sample):
    """Greedy longest matches by string search."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def normal(t):
    d, _, _ = la.symbols(pa.array([t], pa.string()))
    return d.tobytes()


@pytest.mark.parametrize("block", [7, 50, 2048])
def test_phrases_equal_string_search(prose, block):
    """Blocks don't show, not even where a block's own parse never meets the text's: runs of one letter, phrases longer than a block."""
    samples = {"x": normal(prose(1, 120)), "y": normal(prose(2, 90)), "z": b"q" * 11}
    m = la.Model(samples)
    texts = [prose(1, 30), prose(2, 40), prose(3, 200), "Ünder ßtraße über", "", "q" * 300, "q" * 95 + " " + prose(1, 60), prose(1, 120) * 3, "zzzz", "a", "!!", None]
    data, off, letters = la.symbols(pa.array(texts))
    got = m.phrases(data, off, block)
    for i, t in enumerate(texts):
        own = normal(t)
        assert data[off[i] : off[i + 1]].tobytes() == own
        for k, n in enumerate(m.names):
            assert got[k, i] == slow_phrases(own, samples[n]), (t, n)
    assert letters.tolist()[-3:] == [1, 0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = la.fit(docs.where("doc_id % 2 = 0"))
    got = la.identified(docs.where("doc_id % 2 = 1"), m).join(docs, "doc_id").toPandas()
    assert (got.language == got.lang).mean() > 0.97 and got.accepted.mean() > 0.995


def test_foreign_scripts_are_rejected(spark, table):
    m = la.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(1, "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше"), (2, "the thing and that other thing of the nation"), (3, "敏捷的棕色狐狸跳过了懒狗" * 5)]
    r = random.Random(4)
    rows += [(10 + n, "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(40 * n))) for n in range(1, 9)]
    got = {r.doc_id: (r.language, r.accepted) for r in la.identified(table(rows), m).collect()}
    assert not any(got[10 + n][1] for n in range(1, 9))
    assert got[1] == (None, False) and got[3] == (None, False) and got[2] == ("en", True)


def test_odd_and_empty(spark, odd, empty):
    m = la.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = la.identified(odd, m).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.language, r.bits, r.margin, r.accepted) == (None, None, None, False)
    kept = la.accepted(odd, m)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()}.isdisjoint({1, 2, 3, 4})
    assert la.identified(empty, m).collect() == [] and la.accepted(empty, m).collect() == []
    none = la.fit(empty)
    assert {r.accepted for r in la.identified(odd, none).collect()} == {False}


def test_ties_and_bounds(spark):
    rows = [("abc abd", "q"), ("abc abd", "p"), ("abc abd", "q"), (None, "q"), ("zz", None)]
    m = la.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert m.names == ["p", "q"]
    lang, bits, margin = m.judge(pa.array(["abc"]), 99)
    assert lang[0] == 0 and margin[0] == 0 and math.isfinite(bits[0])
    small = la.fit(spark.createDataFrame([("abcdefgh" * 10, "q")], "text string, lang string"), sample_symbols=16)
    assert round(2 ** small.log_size[0]) == 16


def test_automaton_reads_exactly_the_substrings():
    text = b"abracadabra"
    move = la.suffix_automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    read, todo = set(), [(0, b"")]
    while todo:
        s, w = todo.pop()
        read.add(w)
        todo += [(t, w + bytes([c])) for c, t in move[s].items()]
    assert read - {b""} == subs
    assert np.isfinite(la.Model({"a": text}).log_size).all()


def test_a_table_beyond_its_entries_is_refused(monkeypatch):
    monkeypatch.setattr(la, "suffix_automaton", lambda text: [{}] * (1 << 23))
    with pytest.raises(ValueError, match="languages"):
        la.Model({"a": bytes(range(97, 256))})


def test_long_labelled_texts_reach_the_driver_cut(table):
    long = "abc def ghi " * 100_000
    m = la.fit(table([(1, long), (2, "abc. def! GHI " * 5), (3, None)]).replace({"en": "xx"}, subset=["lang"]), sample_symbols=1000)
    assert m.names == ["xx"] and m.log_size.tolist() == [math.log2(1000)]
    with pytest.raises(ValueError, match="table"):
        la.Model({chr(97 + i): bytes(np.random.default_rng(i).integers(97, 250, 60_000, dtype=np.uint8)) for i in range(9)})
