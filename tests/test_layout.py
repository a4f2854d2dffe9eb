import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom import config
from chunkloom.functions import layout as lo


@pytest.mark.parametrize(
    "ids, length, want",
    [
        ([0, 0, 1, 1, 2, 2], 3, [0, 0, 1, 1, 2, 2]),
        ([0] * 4 + [1] * 4, 2, [0, 0, 1, 1, 2, 2, 3, 3]),
        ([0] * 6 + [1] * 6, 2, [i for i in range(6) for _ in range(2)]),
        ([0, 0, 0, 1, 1, 1, -1, -1], 2, [0, 0, 1, 2, 2, 3, -1, -1]),
    ],
)
def test_split_ids(ids, length, want):
    assert lo.split_ids(ids, length) == want


@pytest.mark.parametrize(
    "counts, how, num",
    [
        ([3, 3, 3], {"most": 6}, [2, 1]),
        ([3, 3], {"most": 100}, [2]),
        ([2, 2, 2, 2], {"most": 100, "sents": 2}, [2, 2]),
        ([2, 2, 2], {"most": 100, "sents": 1}, [1, 1, 1]),
        ([3, 3, 3], {"most": 5, "sents": 10}, [1, 1, 1]),
        ([], {"most": 100}, []),
        ([10], {"most": 5}, [1, 1]),
        ([10], {"most": 5, "split": False}, [1]),
    ],
)
def test_greedy_goldens(counts, how, num):
    got = lo.greedy(counts, **how)
    assert [b - a + 1 for a, b, _, _ in got] == num
    assert sum(n for *_, n in got) == sum(counts)


def test_greedy_overlap_and_long_sentences():
    assert lo.greedy([3, 3, 3, 3], 6, overlap=1) == [(0, 1, -1, 6), (1, 2, -1, 6), (2, 3, -1, 6)]
    assert lo.greedy([5, 5, 5], 6, overlap=1) == [(0, 0, -1, 5), (0, 1, -1, 10), (1, 2, -1, 10)]  # an overlap may exceed the limit
    assert lo.greedy([3, 14, 3], 6, overlap=1) == [(0, 0, -1, 3), (1, 1, 0, 6), (1, 1, 1, 6), (1, 1, 2, 2), (2, 2, -1, 3)]
    assert lo.greedy([3, 14, 3], 6, overlap=1, split=False) == [(0, 0, -1, 3), (1, 1, -1, 14), (1, 2, -1, 17)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30), st.integers(1, 15), st.one_of(st.none(), st.integers(1, 4)), st.booleans())
def test_greedy_without_overlap_is_a_partition(counts, most, sents, split):
    got = lo.greedy(counts, most, sents, 0, split)
    assert sum(n for *_, n in got) == sum(counts)
    assert sorted({i for a, b, _, _ in got for i in range(a, b + 1)}) == list(range(len(counts)))
    for a, b, piece, n in got:
        assert n <= most or (not split and a == b)
        assert sents is None or b - a < sents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 20), st.sampled_from([0.0, 0.3, 0.5, 0.9, 1, 3]))
def test_sequences_fit_and_cover(counts, room, overlap):
    us = lo.units(counts, room)
    assert sum(u.n for u in us) == sum(counts) and {u.sent for u in us} == set(range(len(counts)))
    seqs = lo.sequences([u.n for u in us], room, overlap)
    assert all(sum(u.n for u in us[a : b + 1]) <= room for a, b in seqs)
    assert sorted({i for a, b in seqs for i in range(a, b + 1)}) == list(range(len(us)))
    assert all(x[1] + 1 >= y[0] > x[0] or y[1] > x[1] for x, y in zip(seqs, seqs[1:]))
    if overlap == 0.0:
        assert all(y[0] == x[1] + 1 for x, y in zip(seqs, seqs[1:]))


def test_carried_sentences_give_way():
    assert lo.sequences([30, 30, 50, 10], 60, 0.5) == [(0, 1), (2, 3)]
    assert lo.sequences([10] * 8, 60, 0.5) == [(0, 5), (3, 7)]
    assert lo.sequences([5, 0, 5], 5, 0.0) == [(0, 1), (2, 2)]  # an empty sentence doesn't end the text
    assert lo.sequences([], 5, 0.5) == []


def test_windows():
    assert lo.sentence_windows(3, 2, 0) == [(0, 1)]
    assert lo.sentence_windows(3, 2, 0, keep_tail=True) == [(0, 1), (2, 2)]
    assert lo.sentence_windows(1, 2, 0) == [(0, 0)]
    assert lo.sentence_windows(4, 3, 0.5) == [(0, 2), (1, 3)]
    assert lo.sentence_windows(0, 3, 0) == []
    with pytest.raises(ValueError):
        lo.sentence_windows(4, 2, 2)


def test_overlap_count():
    assert [config.overlap_count(0.5, n) for n in (1, 2, 3, 4)] == [0, 1, 2, 2]
    assert config.overlap_count(2, 3) == 2 and config.overlap_count([1, 2], 9, 1) == 2 and config.overlap_count({5: 3}, 5) == 3
    for bad in ((1.0, 3), (-0.1, 3), (3, 3), (-1, 3), ([1], 3), ("x", 3)):
        with pytest.raises(ValueError):
            config.overlap_count(*bad)


def test_batches_and_padding():
    assert [lo.power_of_two(n) for n in (0, 1, 2, 3, 4, 5, 1025)] == [1, 1, 2, 4, 4, 8, 2048]
    assert lo.token_batches([9, 8, 3, 3, 3], 16) == [0, 1, 1, 2, 2]
    assert lo.token_batches([100], 16) == [0] and lo.token_batches([], 16) == []
    assert lo.pad([[1, 2, 3], [4]], 0) == [[1, 2, 3], [4, 0, 0]] and lo.pad([[1], [2, 3]], 9, None) == [[1], [2, 3]]
    assert lo.pad([[1]], 0, "max_length", 3) == [[1, 0, 0]]
    for bad in (([[1]], 0, "max_length", None), ([[1, 2]], 0, "max_length", 1), ([[1]], 0, "other", None)):
        with pytest.raises(ValueError):
            lo.pad(*bad)
    assert lo.collate([[1, 2, 3], [4, 5], [6]]) == {"input_ids": [[1, 2, 3, 0], [4, 5, 0, 0], [6, 0, 0, 0]], "attention_mask": [[1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 0, 0]]}
    assert lo.collate([]) == {} and len(lo.collate([[1, 2, 3]], standardize=False)["input_ids"][0]) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 64))
def test_batches_keep_the_budget(sizes, budget):
    sizes = sorted(sizes, reverse=True)
    no = lo.token_batches(sizes, budget)
    assert len(no) == len(sizes) and no == sorted(no)
    for b in set(no):
        own = [s for s, n in zip(sizes, no) if n == b]
        assert len(own) == 1 or len(own) * lo.power_of_two(max(own)) <= budget
