import itertools
import random
from collections import Counter

import numpy as np
import pytest

from chunkloom.llm import near_text as nt
from chunkloom.llm.common import U, mix
from chunkloom.llm.components import components

from .conftest import shingles


def slow_signature(elements, slots, turns=4000):
    """Every arrival of every element, without early termination."""
    out = [(np.inf, 0)] * slots
    for el, w in elements.items():
        t, seed = 0.0, mix(np.array([el], dtype=U) + U(0x1234567))
        for turn in range(1, turns):
            r = mix(seed + U(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            t -= np.log(((r >> U(11)).astype(float)[0] + 0.5) * 2.0**-53) / w
            s = int((mix(r ^ U(0xA5A5A5A5)) >> U(32)) [0] * U(slots) >> U(32))
            out[s] = min(out[s], (t, el))
            if turn % 64 == 0 and t > max(x for x, _ in out):
                break
    return [el for _, el in out]


def slow_similarity(x, y):
    """The definition: over common d, 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_early_termination_leaves_the_signature_unchanged():
    r = random.Random(3)
    sets = [{r.getrandbits(48): r.randint(1, 5) for _ in range(n)} for n in (1, 2, 7, 40, 150)]
    doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    got = nt.signatures(doc, np.array([e for s in sets for e in s], dtype=U), np.array([w for s in sets for w in s.values()], dtype=float), len(sets), 12)
    assert got.tolist() == [slow_signature(s, 12) for s in sets]


def test_signatures_estimate_probability_jaccard():
    r = random.Random(5)
    x = {r.getrandbits(48): r.randint(1, 4) for _ in range(120)}
    y = {e: w + (k % 3 == 0) for k, (e, w) in enumerate(x.items()) if k > 30} | {r.getrandbits(48): 2 for _ in range(25)}
    a, b = list(x.items()), list(y.items())
    sig = nt.signatures(np.array([0] * len(a) + [1] * len(b)), np.array([e for e, _ in a + b], dtype=U), np.array([w for _, w in a + b], dtype=float), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - slow_similarity(x, y)) < 0.04


def test_similarity_is_exact():
    r = random.Random(7)
    pairs = []
    for _ in range(30):
        base = [r.getrandbits(48) for _ in range(12)]
        pairs.append(tuple({e: r.randint(1, 3) for e in r.sample(base, r.randint(1, 12))} for _ in range(2)))
    cols = [(p, side, e, w) for p, two in enumerate(pairs) for side, s in enumerate(two) for e, w in s.items()]
    pair, side, el, w = (np.array(c) for c in zip(*cols))
    got = nt.similarity(pair, side, el, w, len(pairs))
    assert np.allclose(got, [slow_similarity(x, y) for x, y in pairs])
    assert len(nt.similarity(np.array([], dtype=int), np.array([], dtype=int), np.array([], dtype=int), np.array([], dtype=int), 0)) == 0


def brute_groups(rows, threshold=nt.THRESHOLD):
    """Groups from all pairs."""
    sets = {i: Counter(shingles(t, nt.WORDS)) for i, t in rows if i is not None and shingles(t, 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if find(a) != find(b) and slow_similarity(sets[a], sets[b]) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    groups = Counter(find(i) for i in sets)
    return {(i, find(i), groups[find(i)]) for i in sets if groups[find(i)] > 1}


def edited(text, every, seed):
    r = random.Random(seed)
    w = text.split()
    return " ".join(x if r.random() > 1 / every else f"edit{r.randint(0, 9999)}" for x in w)


@pytest.fixture(scope="module")
def corpus(prose):
    rows = [(i, prose(i, 60 + 5 * i)) for i in range(30)]
    shared = prose(99, 55)
    rows += [(100 + i, prose(200 + i, 300) + " " + shared + " " + prose(300 + i, 300)) for i in range(6)]  # a shared passage is no copy
    rows += [(1000 + i, edited(rows[i % 3][1], 25, i)) for i in range(36)]  # copies of three documents
    rows += [(2000 + i, rows[5][1].upper().replace(" ", "  ")) for i in range(4)]
    return rows


def test_groups_equal_all_pairs(table, corpus):
    got = {tuple(r) for r in nt.near_duplicates(table(corpus)).collect()}
    want = brute_groups(corpus)
    assert len(got & want) >= 0.97 * len(want) and {i for i, _, _ in got} <= {i for i, _, _ in want}
    assert not any(100 <= i < 200 for i, _, _ in got)


def test_large_buckets_are_cut_into_blocks(table, prose):
    """Half of a text is common, so all share buckets and none reaches the threshold but the copies among them."""
    common = prose(7, 60)
    rows = [(i, common + " " + prose(400 + i, 70, 4000)) for i in range(30)] + [(100 + i, common + " " + edited(prose(400 + i, 70, 4000), 30, i)) for i in range(30)]
    want = brute_groups(rows)
    for block in (512, 8):
        assert {tuple(r) for r in nt.near_duplicates(table(rows), bands=40, rows=1, block=block).collect()} == want
    assert len(want) >= 50


def test_more_texts_than_a_slice_has(table, spark):
    """Slices are bounded by rows as well as by bytes: no text takes another's number."""
    import pyarrow as pa

    from chunkloom.llm import common

    column = pa.array([f"w{i}" for i in range(70_000)])
    assert [hi - lo for lo, hi in common.slices(column, 1 << 30)] == [65536, 4464]
    with pytest.raises(ValueError):
        common.weighted(np.array([65536]), np.array([1], dtype=U))
    got = list(nt._sets(iter([pa.RecordBatch.from_arrays([pa.array(range(70_000)), column], ["id", "text"])]), 3))
    assert sum(len(b) for b in got) == 70_000 and all(n == 1 for b in got for n in b.column(1).value_lengths().to_pylist())


def test_nothing_is_left_behind(monkeypatch, table, corpus, tmp_path):
    from chunkloom.sources import tables

    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"file://{tmp_path}")
    nt.near_duplicates(table(corpus[:40])).collect()
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["near-text"]


def test_partitions_do_not_matter(table, corpus):
    one = sorted(map(tuple, nt.near_duplicates(table(corpus).coalesce(1)).collect()))
    assert one == sorted(map(tuple, nt.near_duplicates(table(corpus).repartition(7)).collect()))


def test_one_of_each_group_stays(table, corpus):
    df = table(corpus)
    drop = {r.doc_id for r in nt.near_duplicates(df).collect() if r.doc_id != r.keep_id}
    kept = nt.without_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, _ in corpus if i not in drop)


def test_odd_rows(odd, table):
    assert nt.near_duplicates(odd).collect() == []
    kept = [r.doc_id for r in nt.without_duplicates(odd).select("doc_id").collect()]
    assert sorted(kept, key=str) == sorted([None, 1, 2, 3, 4, 5, 6, 7, 8], key=str)
    same = table([(None, "no id at all"), (None, "no id at all"), (9, "a b c d"), (3, "A, b. C d"), (3, "other words in a second version"), (11, "other words in a second version")])
    assert sorted(map(tuple, nt.near_duplicates(same).collect())) == [(3, 3, 3), (9, 3, 3), (11, 3, 3)]
    assert sorted((r.doc_id for r in nt.without_duplicates(same).select("doc_id").collect()), key=str) == sorted([None, 3, 3], key=str)


def test_rows_without_id_go_only_where_all_columns_agree(spark):
    rows = [(None, "alpha beta gamma delta", "A"), (None, "alpha beta gamma delta", "B"), (None, None, "C"), (None, None, "D"), (None, None, "D"), (4, None, "E"), (4, None, "F"), (4, "other words stand here now", "G"), (4, "other words stand here now", "H"), (5, "unlike all of the others", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string").selectExpr("*", "map('k', more) as m", "array(more) as a")
    kept = nt.without_duplicates(df)
    assert kept.dtypes == df.dtypes
    got = sorted(str((r.doc_id, r.more, r.m)) for r in kept.collect())
    assert [x for x in got if x.startswith("(None")] == [f"(None, '{c}', {{'k': '{c}'}})" for c in "ABCD"]
    assert len(got) == 7 and sum(x.startswith("(4") for x in got) == 2


def test_other_texts_of_a_repeated_id_are_searched_and_kept(table, prose):
    a, b = prose(51, 80), prose(52, 80)
    rows = table([(1, a), (5, a), (5, b), (9, edited(b, 40, 1)), (12, prose(53, 80))])
    assert sorted(map(tuple, nt.near_duplicates(rows).collect())) == [(1, 1, 3), (5, 1, 3), (9, 1, 3)]
    kept = sorted((r.doc_id, r.text) for r in nt.without_duplicates(rows).select("doc_id", "text").collect())
    assert kept == [(1, a), (5, b), (12, prose(53, 80))]


def test_empty(empty):
    assert nt.near_duplicates(empty).collect() == []
    assert nt.without_duplicates(empty).collect() == []


def test_components(spark):
    r = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
