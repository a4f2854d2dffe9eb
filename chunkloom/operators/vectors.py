"""Vector functions as column expressions, similarity, search and size reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.config import Options
from chunkloom.sources.tables import stored

#: Beyond so many numbers of query vectors, tasks read them from the shared folder instead of getting them sent.
MOST_BROADCAST = 1 << 22
#: Queries that are multiplied at once.
QUERY_BLOCK = 2048


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def truncated(a: Column, dim: int) -> Column:
    if dim < 1:
        raise ValueError("dim must be at least 1")
    return F.slice(a, 1, dim)


def halved(a: Column) -> Column:
    """Every number rounded to the nearest 16-bit float, ties to even; Spark has no such type, so the result stays double.

    A 16-bit float has 11 significant bits and exponents from -14 on; from 65520 on it is infinite.
    """

    def one(x: Column) -> Column:
        size = F.abs(x)
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-14.0)) - 10)
        return F.when((x == 0) | F.isnan(x), x).when(size >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(F.rint(x / unit) * unit)

    return F.transform(a.cast("array<double>"), one)


def packed_half(a: Column) -> Column:
    """Two bytes a number, for storage."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if not r.is_valid else np.array(r.as_py(), dtype="<f2").tobytes() for r in rows], pa.binary())

    return run(a.cast("array<double>"))


def postprocessed(a: Column, options: Options) -> Column:
    """Half precision first, then unit length."""
    if options.half:
        a = halved(a)
    return normalized(a) if options.normalize else a


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """The masked mean of each group's vectors: sum(v * w) / max(sum(w), 1), as (keys, dim, value)."""
    w = (F.lit(1) if weight is None else F.coalesce(weight.cast("int"), F.lit(0))).alias("w")
    flat = df.select(*keys, w, F.posexplode(vector).alias("dim", "x"))
    return flat.groupBy(*keys, "dim").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1))).alias("value"))


def top_k(items: DataFrame, queries: DataFrame, k: int | None, metric: str = "dot", most: int = MOST_BROADCAST, digits: int = 6) -> DataFrame:
    """(query_id, rank, <item keys>, score): for each query the k best items; ``items`` has key columns and a last column ``embedding``,
    ``queries`` has (query_id, embedding).  Without k, every item's score for every query, unranked: (query_id, <item keys>, score).

    Scores are rounded first (a half upwards), ties go to the least keys.  Vectors that are null or empty or hold a null, NaN or infinity match
    nothing, nor do zero vectors with cosine, nor vectors of different length each other.

    Every task multiplies its items with blocks of queries and keeps the best k of a query, so that items don't move and at most k rows a query and
    task are shuffled.  If the queries have at most ``most`` numbers they are sent to all tasks; beyond that they are stored in
    the shared folder and tasks read block after block.  The result is the same.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError(f"Invalid metric: {metric!r}")
    keys = [c for c in items.columns if c != "embedding"]
    wanted = queries.where("embedding is not null and query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = wanted.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if total <= most:
        small, files = items.sparkSession.sparkContext.broadcast(wanted.toArrow()), []
    else:
        small, files = None, stored(wanted, "queries").inputFiles()
    kind = queries.schema["query_id"].dataType.simpleString()
    out_type = f"query_id {kind}, " + ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in keys) + ", score double"
    names = ["query_id", *keys, "score"]

    def blocks() -> Iterator[pa.Table]:
        if small is not None:
            for lo in range(0, len(small.value), QUERY_BLOCK):
                yield small.value.slice(lo, QUERY_BLOCK)
        for f in files:
            system, path = fs.FileSystem.from_uri(f)
            with system.open_input_file(path) as x:
                for b in pq.ParquetFile(x).iter_batches(QUERY_BLOCK, columns=["query_id", "embedding"]):
                    yield pa.Table.from_batches([b])

    def scored(part: pa.Table) -> Iterator[pa.Table]:
        own = {v.shape[1]: (rows, v) for rows, v in matrices(part.column("embedding"), metric == "cosine")}
        for block in blocks():
            ids = block.column("query_id").combine_chunks()
            for at, q in matrices(block.column("embedding"), metric == "cosine"):
                if q.shape[1] not in own:
                    continue
                rows, v = own[q.shape[1]]
                s = np.floor(v @ q.T * 10.0**digits + 0.5) / 10.0**digits
                # All that reach the k-th best score of this part stay: ties are settled by keys later.
                cut = -np.inf if k is None else np.partition(s, len(rows) - min(k, len(rows)), axis=0)[len(rows) - min(k, len(rows))]
                i, j = np.nonzero(s >= cut)
                yield pa.Table.from_arrays([ids.take(pa.array(at[j])), *(part.column(c).combine_chunks().take(pa.array(rows[i])) for c in keys), pa.array(s[i, j])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for part in _parts(batches):
            for new in scored(part):
                if k is None:
                    yield from new.combine_chunks().to_batches()
                    continue
                if small is None:  # as many queries as there may be: what is best of a part goes out at once
                    yield from _best(new, keys, k).to_batches()
                    continue
                best = new if best is None else pa.concat_tables([best, new])
                if len(best) > 8 * k * len(small.value) + 65536:
                    best = _best(best, keys, k)
        if best is not None:
            yield from _best(best, keys, k).to_batches()

    found = items.where("embedding is not null").select(*(F.col(f"`{c}`") for c in keys), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, out_type)
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(F.col(f"`{c}`") for c in keys))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", *(F.col(f"`{c}`") for c in keys), "score")


def _parts(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for lo in range(0, len(b), most):
            held.append(b.slice(lo, most))
            if sum(map(len, held)) >= most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def matrices(column: pa.ChunkedArray | pa.Array, unit: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vector, without those that match nothing; at unit length if asked."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        ok = np.isfinite(v).all(axis=1)
        if unit:
            n = np.sqrt((v * v).sum(axis=1))
            ok &= n > 0
            v = v[ok] / n[ok][:, None]
        else:
            v = v[ok]
        if len(v):
            yield rows[ok], v


def _best(t: pa.Table, keys: list[str], k: int) -> pa.Table:
    t = t.sort_by([("query_id", "ascending"), ("score", "descending"), *((c, "ascending") for c in keys)]).combine_chunks()
    q = t.column("query_id").combine_chunks()
    new = np.append(True, np.asarray(pc.not_equal(q[1:], q[:-1])))
    at = np.flatnonzero(new)
    rank = np.arange(len(q)) - at[np.cumsum(new) - 1]
    return t.filter(pa.array(rank < k))


def format_bytes(n: Column) -> Column:
    """1023.00 B, 1.00 KB and so on up to PB, by powers of 1024."""
    out = None
    for p, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        text = F.concat(F.format_string("%.2f", (n / (1024.0**p)).cast("double")), F.lit(f" {unit}"))
        cond = n < 1024 ** (p + 1)
        out = F.when(cond, text) if out is None else (out.when(cond, text) if p < 5 else out.otherwise(text))
    return out


def memory_report(df: DataFrame, key: str, vector: str = "embedding", width: int = 4) -> DataFrame:
    """(key, n_vectors, n_bytes, size) and a row ``_total_``."""
    size = F.sum(F.size(vector).cast("bigint") * width)
    one = df.select(F.col(key).cast("string").alias(key), vector)
    by = one.rollup(key).agg(F.grouping(key).alias("g"), F.count("*").alias("n_vectors"), F.coalesce(size, F.lit(0)).alias("n_bytes"))
    return by.select(F.when(F.col("g") == 1, "_total_").otherwise(F.col(key)).alias(key), "n_vectors", "n_bytes", format_bytes(F.col("n_bytes")).alias("size"))
