import pytest
from pyspark.sql import functions as F

from chunkloom.operators import chunks as ch
from chunkloom.operators import text as tx

ODD = [(1, "Hello world. How are you?\n\nFine!  "), (2, ""), (3, None), (4, " \t\n"), (5, "..."), (6, "no stop"), (7, "Ünï. ﬁn 😀 x! 12,5 a_b"), (8, "x. " * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def test_both_ways_to_find_sentences_agree(odd):
    a = {(r.doc_id, r.sent_id): r.text for r in tx.sentences(odd).collect()}
    b = {(r.doc_id, r.pos): r.col for r in odd.select("doc_id", F.posexplode(tx.sentence_texts(F.col("text")))).collect()}
    assert a == b and not {2, 3, 4} & {d for d, _ in a}
    text = dict(ODD)
    assert all(text[r.doc_id][r.start : r.end] == r.text == r.text.strip(" \t\r\f\v") != "" for r in tx.sentences(odd).collect())
    assert [t for (d, _), t in sorted(a.items()) if d == 1] == ["Hello world.", "How are you?", "Fine!"]
    assert tx.sentence_offsets(" a b \r\n c .. d! \t") == [(1, 4), (8, 12), (13, 15)]


def test_abbreviations():
    t = "Dr. Smith went to Washington. He met with U.S. officials."
    assert [t[a:b] for a, b in tx.sentence_offsets(t, "regex-abbrev")] == ["Dr. Smith went to Washington.", "He met with U.S. officials."]
    assert tx.sentence_offsets("") == [] and tx.sentence_offsets(["a. b.", ""]) == [[(0, 2), (3, 5)], []]
    with pytest.raises(ValueError, match="Invalid method"):
        tx.sentence_offsets("x", "none")
    for missing in ("blingfire", "nltk", "pysbd", "syntok"):
        with pytest.raises(ImportError, match="install"):
            tx.sentence_offsets("x.", missing)


def test_places_from_a_cursor():
    assert tx._from_cursor("a b a", ["a", "a", "z"]) == [(0, 1), (4, 5), (5, 6)]


def test_tokens(odd):
    text = dict(ODD)
    rows = tx.tokens(odd).collect()
    assert all(text[r.doc_id][r.start : r.end].lower() == r.token for r in rows)
    sents = {(r.doc_id, r.sent_id): (r.start, r.end) for r in tx.sentences(odd).collect()}
    for r in rows:
        own = [s for (d, s), (a, b) in sents.items() if d == r.doc_id and a <= r.start and r.end <= b]
        assert [r.sent_id] == (own or [None])
    words = {r.doc_id: r.w for r in odd.select("doc_id", tx.words(F.col("text")).alias("w")).collect()}
    for d in (1, 6, 7, 8):
        assert [r.token for r in sorted(rows, key=lambda r: r.tok_id) if r.doc_id == d] == words[d]
    led = [r for r in tx.tokens(odd.where("doc_id = 6"), prompt="find this: ").collect()]
    assert [(r.token, r.sent_id) for r in led] == [("find", None), ("this", None), ("no", 0), ("stop", 0)] and led[0].start == -11


def test_overflow_and_truncation(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 5, 6, 7, 20)], "t array<int>")
    for (got, short), n in zip(df.select(tx.overflow_windows(F.col("t"), 5, 2), tx.truncated(F.col("t"), 5)).collect(), (0, 1, 5, 6, 7, 20)):
        want, s = [], 0
        while n:
            want.append(list(range(n))[s : s + 5])
            if s + 5 >= n:
                break
            s += 3
        assert got == want and short == list(range(n))[:3]
    with pytest.raises(ValueError):
        tx.overflow_windows(F.col("t"), 5, 5)


def test_expressions_equal_plain_functions(spark):
    from chunkloom.functions import layout

    counts = [[], [0], [3, 0, 17, 5], [8] * 9, [40]]
    df = spark.createDataFrame([(c,) for c in counts], "c array<int>")
    cols = [ch.long_units(F.col("c"), 8), ch.windows(F.size("c"), 3, 1), ch.windows(F.size("c"), 3, 1, keep_tail=True), ch.greedy_chunks(F.col("c"), 10, 3, 1), ch.packed_sequences(F.col("c"), 12, 0.5)]
    for c, (u, w, tail, g, s) in zip(counts, df.select(*cols).collect()):
        assert [(x.sent, x.sub, x.n) for x in u] == [(x.sent, x.sub, x.n) for x in layout.units(c, 8)]
        assert [tuple(x) for x in w] == layout.sentence_windows(len(c), 3, 1)
        assert [tuple(x) for x in tail] == layout.sentence_windows(len(c), 3, 1, keep_tail=True)
        assert [tuple(x) for x in g] == layout.greedy(c, 10, 3, 1)
        assert len(s) == len(layout.sequences([x.n for x in layout.units(c, 12)], 12, 0.5))
