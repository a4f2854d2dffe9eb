import random

import numpy as np
import pytest

from chunkloom.llm import contamination as co

from .conftest import shingles


@pytest.fixture(scope="module")
def case(prose, spark):
    items = [(i, prose(1000 + i, 14 + 3 * i)) for i in range(12)] + [(50, "three short words"), (51, None), (52, ""), (1, prose(77, 30))]
    rows = [(i, prose(i, 200 + 40 * i)) for i in range(20)]
    rows += [(100 + i, prose(300 + i, n) + " " + items[i % 12][1] + " " + prose(400 + i, n)) for i, n in enumerate((1, 10, 100, 1000, 10_000, 30_000))]
    half = items[9][1].split()
    rows += [(200, prose(9, 50) + " " + " ".join(half[: len(half) * 9 // 10])), (201, prose(10, 50) + " " + " ".join(half[: len(half) // 2])), (202, items[3][1].upper()), (203, "three short words"), (204, "not three short words")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def brute(rows, items):
    out = set()
    for i, t in items:
        own = set(shingles(t, co.WORDS))
        for d, x in rows:
            n = len(own & set(shingles(x, co.WORDS)))
            if own and n >= co.THRESHOLD * len(own) - 1e-9:
                out.add((d, i, n, len(own), round(n / len(own), 6)))
    return out


@pytest.mark.parametrize("most", [co.MOST_BROADCAST, 0])
def test_equals_brute_force(table, case, most):
    rows, items, bench = case
    got = co.contaminated(table(rows), bench, most=most).collect()
    want = brute(rows, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {200, 202, 203} <= {r.doc_id for r in got} and not {201, 204} & {r.doc_id for r in got}


@pytest.mark.parametrize("most", [co.MOST_BROADCAST, 0])
def test_rows_without_items_stay(table, case, odd, most):
    rows, items, bench = case
    bad = {d for d, *_ in brute(rows, items)}
    kept = co.decontaminated(table(rows), bench, most=most)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad)
    assert co.decontaminated(odd, bench, most=most).count() == odd.count()


@pytest.mark.parametrize("most", [co.MOST_BROADCAST, 0])
def test_odd_and_empty(odd, empty, case, spark, table, most):
    bench = case[2]
    assert co.contaminated(odd, bench, most=most).collect() == []
    assert co.contaminated(empty, bench, most=most).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert co.contaminated(odd, nothing, most=co.MOST_BROADCAST).collect() == []
    assert co.decontaminated(odd, nothing).count() == odd.count()
    again = table([(None, "three short words"), (4, "three short words"), (4, "three short words")])
    assert sorted((str(r.doc_id) for r in co.contaminated(again, bench, most=most).collect())) == ["4", "4", "None"]


def test_sketches_find_nearly_all_pairs_at_the_threshold():
    r = random.Random(1)
    hit = total = 0
    for n in (20, 200, 2000, 20_000):
        for _ in range(40):
            item = np.unique(np.array([r.getrandbits(48) for _ in range(12)], dtype=np.uint64))
            shared = item[: -(-7 * len(item) // 10)]
            el = np.unique(np.concatenate([shared, np.array([r.getrandbits(48) for _ in range(n)], dtype=np.uint64)]))
            found = co.Items(np.zeros(len(item), dtype=np.int64), item, 0.7, co.MISS).find(np.zeros(len(el), dtype=np.int64), el, 1)
            hit, total = hit + len(found[0]), total + 1
    assert hit >= 0.97 * total


def test_fewer_elements_are_kept_of_longer_documents():
    load = co.bin_load(40, 0.7, co.MISS)
    el = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    assert co.sketch(np.zeros(len(el)), el, co.partition_bits(np.full(len(el), len(el)), load)).sum() < len(el) / 2
