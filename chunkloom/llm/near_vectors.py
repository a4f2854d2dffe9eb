"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verification, classes.

A hash multiplies a vector, filled up to a power of two, by random signs and the Hadamard matrix three times and
takes the nearest of the 2d signed axes.  ``k`` hashes make a table's bucket; a vector is in its own bucket of each table
and in the ``probes`` buckets that a second-nearest axis leads to at the least loss.  Numbers of hashes and tables follow from
how often pairs exactly at the threshold meet, which is measured with the same hashes on random pairs of that dimension, so
that one found with probability ``recall`` or more at any dimension and threshold.

Equal vectors are one node.  All members of a bucket are compared by blocks of matrices: a large bucket is cut into blocks
and every pair of blocks is a unit of work of its own, so that no task holds more than two blocks, and a unit returns only
what connects its members, never its pairs.  Links lie inside the resulting classes, where they are counted by the same blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import U, columns, fresh, lists, mix, scratch, stored
from chunkloom.llm.components import components

THRESHOLD, RECALL, PROBES, SEED = 0.95, 0.99, 3, 20240613
#: Members of a block: two of them make a unit of work.
BLOCK = 2048
#: Random pairs that the rate of meetings is measured on.
TRIALS = 2048
Keys = Callable[[np.ndarray], np.ndarray]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate((y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]), axis=-2).reshape(*x.shape[:-1], n)
        h *= 2
    return x


def axes(x: np.ndarray, hash_no: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest signed axis, second nearest, loss of taking the second) of each row under one rotation."""
    d = x.shape[1]
    for r in range(3):
        signs = 1 - 2 * (mix(np.arange(d, dtype=U) + U(((seed * 1000003 + hash_no) * 3 + r) % 2**63 << 20 & 2**64 - 1)) & U(1)).astype(np.float32)
        x = hadamard(x * signs) / np.float32(math.sqrt(d))
    a = np.abs(x)
    row = np.arange(len(x))
    best = a.argmax(axis=1)
    top = a[row, best]
    a[row, best] = -1
    second = a.argmax(axis=1)
    return best * 2 + (x[row, best] < 0), second * 2 + (x[row, second] < 0), top - a[row, second]


def bucket_keys(x: np.ndarray, k: int, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys of unit vectors: a vector's own bucket of each table first."""
    d = max(16, 1 << max(0, x.shape[1] - 1).bit_length())
    full = np.zeros((len(x), d), dtype=np.float32)
    full[:, : x.shape[1]] = x
    probes = min(probes, k)
    row = np.arange(len(x))
    out = np.empty((len(x), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        got = [axes(full, t * k + j, seed) for j in range(k)]
        own, other = np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)
        order = np.argsort(np.stack([g[2] for g in got], axis=1), axis=1, kind="stable")
        for p in range(1 + probes):
            code = own.copy()
            if p:
                code[row, order[:, p - 1]] = other[row, order[:, p - 1]]
            h = np.full(len(x), t * 65537 + x.shape[1], dtype=U)
            for j in range(k):
                h = mix(h * U(1000003) + code[:, j].astype(U))
            out[:, t, p] = h.astype(np.int64)
    return out


@lru_cache(256)
def meetings(k: int, dim: int, threshold: float, probes: int, seed: int) -> float:
    """How often two vectors whose cosine is the threshold share a bucket of a table: 2.5 standard errors below what is measured."""
    r = np.random.default_rng(k * 65537 + dim)
    x, y = r.normal(size=(2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None]
    y = threshold * x + math.sqrt(max(0, 1 - threshold**2)) * y if dim > 1 else x
    met = 0
    for t, part in enumerate(np.array_split(np.arange(TRIALS), 8)):
        a, b = (bucket_keys(z[part].astype(np.float32), k, 1, probes, seed + t)[:, 0] for z in (x, y))
        met += (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).sum()
    p = met / TRIALS
    return min(0.999, p - 2.5 * math.sqrt(p * (1 - p) / TRIALS)) if met else 0.0


@lru_cache(256)
def shape(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES, seed: int = SEED) -> tuple[int, int]:
    """(hashes a table, tables) for n vectors: those with the least work among all that reach the recall.

    Work, in microseconds a vector, is rotations, bucket entries, and comparisons with vectors that are in a bucket by chance.
    """
    d, best = max(16, 1 << max(0, dim - 1).bit_length()), (math.inf, 1, 1)
    for k in range(1, 33):
        if k * d * 0.03 > best[0]:
            break
        p = meetings(k, dim, threshold, probes, seed)
        if p <= 0:
            break
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        entries = 1 + min(probes, k)
        work = tables * (k * d * 0.03 + entries * 4 + entries**2 * n / (2.0 * d) ** k * (1 + dim * 0.02))
        best = min(best, (work, k, tables))
    return best[1:]


def _matrix(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """These rows, which have d numbers each, at unit length."""
    v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _node(v: Column) -> Column:
    """128 bits of the vector."""
    return F.struct(F.xxhash64(v).alias("x"), F.xxhash64(F.lit(SEED), v).alias("y"))


def linked(unit: np.ndarray, side: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the pairs that reach the threshold, within runs of equal ``unit``: all pairs of a run, or,
    where a run has both sides, those across.  Small runs are compared at once, large ones by a matrix product each."""
    at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(at, len(unit)))
    mixed = np.add.reduceat(side, at) > 0
    small = (size <= 48) & ~mixed
    out_i, out_j = [], []
    of = np.repeat(np.arange(len(at)), size)
    left = np.where(small[of], at[of] + size[of] - 1 - np.arange(len(unit)), 0)  # partners behind a row
    upto = np.cumsum(left)
    lo = 0
    while lo < len(unit):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 17), side="right")))
        n = left[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
        out_i.append(i[ok])
        out_j.append(j[ok])
        lo = hi
    for g in np.flatnonzero(~small):
        a, b = at[g], at[g] + size[g]
        cut = a + int((side[a:b] == 0).sum()) if mixed[g] else b
        for x in range(a, cut, 512):
            y = min(x + 512, cut)
            i, j = np.nonzero(v[x:y] @ v[cut if mixed[g] else x : b].T >= threshold)
            i, j = i + x, j + (cut if mixed[g] else x)
            ok = i < j
            out_i.append(i[ok])
            out_j.append(j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(members: DataFrame, nodes: DataFrame, group: str, block: int) -> DataFrame:
    """(group, lo, hi, side, node, v[, ...]) sorted: each pair of blocks of a group of more than one member.

    Members are spread over blocks by hash; sizes are pre-aggregated, so a large group needs no task of its own.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    cut = members.join(sizes, group).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cut = cut.withColumn("own", F.expr("cast(pmod(xxhash64(node, 31), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(F.col(group).alias("g"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    return cut.join(nodes, "node").repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "side")


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("g", "lo", "hi")) -> Iterator[pa.Table]:
    """Tables that end where a unit ends, and their units as numbers."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        new = _changes(t, names)
        if len(new) > 1 and len(t) >= 4096:
            cut = int(new[-1])
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _changes(t: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(len(t), dtype=bool)
    new[:1] = True
    for n in names:
        c = t.column(n).combine_chunks()
        if pa.types.is_struct(c.type):
            parts = [f.to_numpy() for f in c.flatten()]
        else:
            parts = [c.to_numpy()]
        for x in parts:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _compared(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, i, j) of the linked rows of a table of whole units, for each length of vector."""
    starts = _changes(t, ("g", "lo", "hi"))
    unit = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    side = t.column("side").to_numpy()
    column = t.column("v").combine_chunks()
    size = np.asarray(column.value_lengths())
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        i, j = linked(unit[rows], side[rows], _matrix(column, rows, int(d)), threshold)
        yield rows, i, j


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES, seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, class_size, n_links), a row for each distinct pair of an id and a usable vector.

    Two rows are linked if their vectors' cosine is ``threshold`` or more.  A class is what links connect; ``class_id`` is
    its least id, ``n_links`` counts the rows that a row is linked with.  A row without links is a class of its own.

    A pair at the threshold is found with probability ``recall`` or more, a pair above it rather more often; links are
    verified, and counted in full within a class.  Rows whose id is null, or whose vector is null, empty, zero or holds a null, NaN or
    infinity, are left out.  Vectors of different length are never linked.  Rows equal in id and vector are one; an id with
    several vectors has a row for each.  Other columns are not read; an empty table gives no rows.
    """
    return _rows(vectors, threshold, recall, probes, seed, block, id_col, vector_col).select(F.col("id").alias("vec_id"), "class_id", "class_size", "n_links")


def _numbers(v: Column, kind: str) -> Column:
    return v if kind in ("array<float>", "array<double>") else v.cast("array<double>")


def _rows(vectors: DataFrame, threshold: float, recall: float, probes: int, seed: int, block: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, class_id, class_size, n_links)."""
    base = columns(vectors, id_col, vector_col).toDF("id", "v")
    base = base.withColumn("v", _numbers(F.col("v"), base.schema["v"].dataType.simpleString()))
    base = base.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "v", _node(F.col("v")).alias("node"))
    kind, number = base.schema["node"].dataType, base.schema["v"].dataType.simpleString()
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, usual = size.n, size.d
    ready = shape(n, usual, threshold, recall, probes, seed) if n else None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(1).value_lengths())
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                k, tables = ready if d == usual else shape(n, d, threshold, recall, probes, seed)
                keys = bucket_keys(_matrix(b.column(1), rows, d).astype(np.float32), k, tables, probes, seed).reshape(len(rows), -1)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists(keys.ravel(), np.full(len(rows), keys.shape[1]), pa.int64())], ["node", "v", "keys"])

    with scratch(vectors.sparkSession):
        units = stored(base.select("id", "node").distinct(), "units")
        made = base.select("node", "v").mapInArrow(hashed, f"node {kind.simpleString()}, v {number}, keys array<bigint>")
        nodes = stored(made.groupBy("node").agg(F.first("v").alias("v"), F.first("keys").alias("keys")), "nodes")

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole(batches):
                node = t.column("node").combine_chunks()
                for rows, i, j in _compared(t, threshold):
                    label = spanning(i, j, len(rows))
                    more = np.flatnonzero(label != np.arange(len(rows)))
                    if len(more):
                        yield pa.RecordBatch.from_arrays([node.take(pa.array(rows[more])), node.take(pa.array(rows[label[more]]))], ["a", "b"])

        members = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
        edges = _units(members, nodes.select("node", "v"), "key", block).select("g", "lo", "hi", "side", "node", "v").mapInArrow(joined, f"a {kind.simpleString()}, b {kind.simpleString()}")
        weights = stored(units.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "weights")
        classes = stored(components(edges).withColumnsRenamed({"id": "node"}).join(weights, "node"), "classes")
        whole = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("w").alias("class_size"))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole(batches):
                node, w = t.column("node").combine_chunks(), t.column("w").to_numpy()
                for rows, i, j in _compared(t, threshold):
                    links = np.bincount(i, w[rows[j]], len(rows)) + np.bincount(j, w[rows[i]], len(rows))
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(rows)), pa.array(links.astype(np.int64))], ["node", "links"])

        weighed = nodes.select("node", "v").join(classes.select("node", "w"), "node")
        links = _units(classes.select("node", "root"), weighed, "root", block).select("g", "lo", "hi", "side", "node", "v", "w").mapInArrow(counted, f"node {kind.simpleString()}, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
        known = classes.join(whole, "root").join(links, "node").select("node", "class_id", "class_size", "links")
        named = weights.join(known, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_size", "w").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
        return stored(units.join(named, "node").select("id", "node", "class_id", "class_size", "n_links"), "near-vectors", lasts=True)


def without_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES, seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The table without near copies: of each class the rows with its least id stay.  All columns stay.

    Rows that are in no class, for their id is null or their vector not usable, stay.  Of an id with several vectors
    those go that are in another id's class.
    """
    gone, gone_node, node = fresh(vectors, "gone_id", "gone_node", "node")
    drop = _rows(vectors, threshold, recall, probes, seed, block, id_col, vector_col).where("id <> class_id").select(F.col("id").alias(gone), F.col("node").alias(gone_node))
    v = F.col(f"`{vector_col}`")
    marked = vectors.withColumn(node, F.when(F.size(v) > 0, _node(_numbers(v, vectors.schema[vector_col].dataType.simpleString()))))
    return marked.join(drop, (F.col(f"`{id_col}`") == F.col(gone)) & (F.col(node) == F.col(gone_node)), "left_anti").select(*(F.col(f"`{c}`") for c in vectors.columns))


#: Links by all pairs, classes by their transitive closure.
ORACLE = f"""
    WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id, e) AS n, * FROM (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
    links AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    reach(a, b) AS (SELECT n, n FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT x.vec_id, min(y.vec_id) AS class_id, count(*) AS class_size, (SELECT count(*) FROM links WHERE a = x.n) AS n_links
    FROM reach r JOIN v x ON x.n = r.a JOIN v y ON y.n = r.b GROUP BY x.n, x.vec_id"""
