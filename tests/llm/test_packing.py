import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import packing as pk
from chunkloom.llm import tokenizer as tk


def slow_differencing(sizes, parts):
    """The textbook form: tuples of all parts, empty ones included; of equal imbalances the partial partition made first goes first."""
    todo = [(sorted([s] + [0] * (parts - 1), reverse=True), n) for n, s in enumerate(sizes)]
    n = len(todo)
    while len(todo) > 1:
        todo.sort(key=lambda x: (x[0][-1] - x[0][0], x[1]))
        (a, _), (b, _) = todo[:2]
        todo = todo[2:] + [(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), n)]
        n += 1
    return todo[0][0] if todo else [0] * parts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=16), st.integers(1, 6))
def test_sums_equal_the_textbook_form(sizes, parts):
    windows = pk.differencing(sizes, parts)
    got = sorted((sum(sizes[i] for i in w) for w in windows), reverse=True)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert got + [0] * (parts - len(got)) == slow_differencing(sizes, parts)


def test_textbook_examples():
    assert sorted(map(sum, ([(8, 7, 6, 5, 4)[i] for i in w] for w in pk.differencing([8, 7, 6, 5, 4], 2)))) == [14, 16]
    assert sorted(map(sum, ([(8, 7, 6, 5, 4)[i] for i in w] for w in pk.differencing([8, 7, 6, 5, 4], 3)))) == sorted(slow_differencing([8, 7, 6, 5, 4], 3))


def test_windows_are_nearly_as_few_as_possible():
    r = random.Random(2)
    for _ in range(60):
        sizes = [r.randint(1, 10) for _ in range(r.randint(1, 8))]
        windows = pk.pack(sizes, 10)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 10 for w in windows)
        best = next(k for k in range(1, 9) if any(all(sum(s for s, c in zip(sizes, cut) if c == j) <= 10 for j in range(k)) for cut in itertools.product(range(k), repeat=len(sizes))))
        assert len(windows) <= best + 1
    assert pk.pack([], 10) == [] and len(pk.pack([10] * 7, 10)) == 7


def rebuilt(windows, capacity):
    """The token lists of all texts, from windows alone, as a multiset of (id, tokens)."""
    pieces = {}
    for w in windows:
        assert w.n_tokens == sum(w.lengths) == len(w.token_ids) <= capacity and len(w.doc_ids) == len(w.text_hashes) == len(w.starts) == len(w.lengths)
        at = 0
        for d, h, s, n in zip(w.doc_ids, w.text_hashes, w.starts, w.lengths):
            pieces.setdefault((d, h), {}).setdefault(s, []).append(w.token_ids[at : at + n])
            at += n
    out = Counter()
    for (d, _), by_start in pieces.items():
        copies = {len(x) for x in by_start.values()}
        assert len(copies) == 1 and all(all(y == x[0] for y in x) for x in by_start.values())
        tokens = []
        for s in sorted(by_start):
            assert s == len(tokens)
            tokens += by_start[s][0]
        out[d, tuple(tokens)] += copies.pop()
    return out


def wanted(rows):
    return Counter((i, tuple(tk.token_ids(t).tolist())) for i, t in rows if t)


def test_every_token_is_in_one_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = wanted((r.doc_id, r.text) for r in docs.collect())
    windows = pk.packed(docs, capacity=1024).collect()
    assert rebuilt(windows, 1024) == want
    assert sum(n * len(t) for (_, t), n in want.items()) / (1024 * len(windows)) > 0.9
    fewer = pk.packed(docs.repartition(5), capacity=1024).collect()
    assert sorted(map(str, fewer)) == sorted(map(str, windows))


def test_odd_and_empty(odd, empty, table):
    windows = pk.packed(odd, capacity=512).collect()
    assert rebuilt(windows, 512) == wanted((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())
    assert {d for w in windows for d in w.doc_ids} == {None, 3, 4, 5, 6, 7, 8}
    assert [d for w in windows for d in w.doc_ids].count(5) == 2
    assert pk.packed(empty).collect() == []
    same = table([(1, "a b c")] * 40 + [(None, "d e f " * n) for n in range(1, 30)] + [(1, "g h i " * n) for n in range(20)])
    assert rebuilt(pk.packed(same, capacity=16, group_items=8).collect(), 16) == wanted((r.doc_id, r.text) for r in same.select("doc_id", "text").collect())
