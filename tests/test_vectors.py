import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.config import Options
from chunkloom.operators import chunks as ch
from chunkloom.operators import vectors as vx
from chunkloom.operators.batches import batch_plan, padded, power_of_two
from chunkloom.operators.order import numbered


def one(spark, expr, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v array<double>").orderBy("i").select(expr).collect()]


def test_normalize_truncate(spark):
    v = F.col("v")
    assert one(spark, vx.normalized(v), [3.0, 4.0], [0.0, 0.0], None, []) == [[0.6, 0.8], [0.0, 0.0], None, []]
    assert one(spark, vx.truncated(v, 2), [1.0, 2.0, 3.0], [1.0]) == [[1.0, 2.0], [1.0]]
    with pytest.raises(ValueError):
        vx.truncated(v, 0)


def test_half_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=500), r.normal(size=300) * 1e-6, r.normal(size=300) * 3e4, [0, -0.0, 65504, 65519.99, 65520, -1e9, 2**-24, 2**-25, 2**-25 * 1.01, 1 + 2**-11, 1 + 3 * 2**-11, 0.99999999, float("inf"), float("nan")]])
    (got,) = one(spark, vx.halved(F.col("v")), x.tolist())
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float64)
    assert np.array_equal(np.array(got), want, equal_nan=True)
    (raw,) = one(spark, vx.packed_half(F.col("v")), [1.5, -2.0])
    assert np.frombuffer(raw, "<f2").tolist() == [1.5, -2.0]
    (post,) = one(spark, vx.postprocessed(F.col("v"), Options(half=True, normalize=True)), [0.1, 0.2])
    h = np.array([0.1, 0.2]).astype(np.float16).astype(float)
    assert np.allclose(post, h / np.linalg.norm(h))


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vx.dot(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 1.0 and abs(got[0][1] - 2**-0.5) < 1e-12 and tuple(got[1]) == (0.0, None)


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_search_is_the_same_however_queries_reach_the_tasks(spark, metric):
    r = np.random.default_rng(2)
    items = [(i, j, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(40) for j in range(3)] + [(99, 0, None), (98, 0, [0.0] * 4), (97, 0, [1.0, 1.0]), (96, 0, [1.0, None, 1.0, 1.0]), (95, 0, [float("nan"), 1.0, 1.0, 1.0]), (94, 0, [])]
    queries = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(12)] + [(77, None), (78, [0.0] * 4), (79, [2.0, 3.0]), (80, [1.0, 1.0, None, 1.0])]
    a = spark.createDataFrame(items, "doc_id long, chunk_idx int, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    fast, slow = (sorted(map(tuple, vx.top_k(a, q, 5, metric, most=m).collect())) for m in (1 << 20, 0))
    want = []
    for i, x in queries:
        if i < 77 or i == 79 or (i == 78 and metric == "dot"):
            x = np.array(x)
            own = [(j, n, np.array(v, dtype=float)) for j, n, v in items if v and len(v) == len(x) and None not in v and np.isfinite(v).all() and (metric == "dot" or np.any(v))]
            score = lambda v: float(x @ v) / (1 if metric == "dot" else np.linalg.norm(x) * np.linalg.norm(v))  # noqa: E731, B023
            best = sorted((-(np.floor(score(v) * 1e6 + 0.5) / 1e6), j, n) for j, n, v in own)[:5]
            want += [(i, r, j, n, -s + 0.0) for r, (s, j, n) in enumerate(best, 1)]
    assert fast == slow == sorted(want) and len(fast) >= 12 * 4
    assert vx.top_k(a, q.where("false"), 5, metric).collect() == [] == vx.top_k(a.where("false"), q, 5, metric).collect()
    with pytest.raises(ValueError):
        vx.top_k(a, q, 5, "none")


def test_deduplicate_goldens(spark):
    rows = [("A", 0, [1.0, 2.0, 3.0]), ("B", 1, [4.0, 5.0, 6.0]), ("A", 2, [7.0, 8.0, 9.0]), ("B", 3, [10.0, 11.0, 12.0])]
    df = spark.createDataFrame(rows, "k string, n int, embedding array<double>")
    got = ch.deduplicate(df, ["k"], ["n"]).orderBy("k").collect()
    assert [(r.k, r.n, r.embedding) for r in got] == [("A", 0, [4.0, 5.0, 6.0]), ("B", 1, [7.0, 8.0, 9.0])]
    first = spark.createDataFrame([("A", 0, [1.0, 2.0]), ("A", 1, [3.0, 4.0]), ("B", 2, [5.0, 6.0])], df.schema)
    assert [r.embedding for r in ch.deduplicate(first, ["k"], ["n"], method="first").orderBy("k").collect()] == [[1.0, 2.0], [5.0, 6.0]]
    with pytest.raises(ValueError, match="Invalid method"):
        ch.deduplicate(df, ["k"], ["n"], method="last")


def test_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1048576, 1 << 30, 1 << 40, 1 << 50, 1 << 62)], "n long")
    assert [r[0] for r in df.select(vx.format_bytes(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.00 MB", "1.00 GB", "1.00 TB", "1.00 PB", "4096.00 PB"]
    rep = vx.memory_report(spark.createDataFrame([("x", [1.0, 2.0]), ("x", [1.0]), (None, [3.0])], "k string, embedding array<double>"), "k")
    assert {r.k: (r.n_vectors, r.n_bytes) for r in rep.collect()} == {"x": (2, 12), None: (1, 4), "_total_": (3, 16)}


def test_masked_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], True), (1, [3.0, 6.0], True), (1, [9.0, 9.0], False), (2, [5.0, 5.0], False)], "k int, v array<double>, m boolean")
    got = {(r.k, r.dim): r.value for r in vx.mean_vectors(df, ["k"], "v", F.col("m")).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 4.0, (2, 0): 0.0, (2, 1): 0.0}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_wide_rows_have_no_gaps_and_no_repeats(spark, adaptive):
    """More than one range partition, of rows whose width differs, in whatever way Spark joins small partitions."""
    wide = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("a"), F.expr("id % 3").alias("b"), F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 9).cast("int")).alias("payload"), F.array(F.col("id").cast("double")).alias("v"))
    keys = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = numbered(wide, ["a", "b"])
        assert got.columns == ["idx", "a", "b", "payload", "v"]
        assert tuple(got.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.sum((F.col("idx") != F.col("a")).cast("int"))).first()) == (60_000, 60_000, 0, 59_999, 0)
        assert sorted(r.idx for r in numbered(wide.where("a < 50").select(F.lit(1).alias("a"), "b"), ["a"]).collect()) == list(range(50))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_order_and_batches(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "a long, b long").repartition(6)
    assert [(r.idx, r.a) for r in numbered(df, ["a"]).orderBy("idx").collect()] == [(i, i) for i in range(101)]
    assert numbered(df.where("false"), ["a"]).collect() == []
    plan = batch_plan(df.select("b", F.col("a").alias("n")), "b", "n", 256).collect()
    assert len(plan) == 101 and all(r.batch_rows == 1 or r.batch_rows * r.width <= 256 for r in plan)
    by = batch_plan(df.select((F.col("b") % 3).alias("g"), "b", F.col("a").alias("n")), "b", "n", 256, "g").collect()
    assert len(by) == 101 and all(r.batch_rows == 1 or r.batch_rows * r.width <= 256 for r in by)
    for g in range(3):
        own = sorted((r for r in by if r.g == g), key=lambda r: (-r.n, r.b))
        from chunkloom.functions import layout

        assert [r.batch_no for r in own] == layout.token_batches([r.n for r in own], 256)
    got = spark.createDataFrame([([1, 2, 3],), ([],)], "v array<int>").select(padded(F.col("v"), F.lit(0), power_of_two(F.size("v")))).collect()
    assert [r[0] for r in got] == [[1, 2, 3, 0], [0]]
    ns = spark.range(1, 70).select("id", power_of_two(F.col("id")).alias("p")).collect()
    assert all(r.p == 1 << (r.id - 1).bit_length() for r in ns)
