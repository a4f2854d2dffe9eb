"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification, components.

A document is the weighted set of its runs of ``words`` words, a run weighing as often as it
occurs.  Each run is a Poisson process whose rate is its weight; every arrival falls on one of
``bands * rows`` slots, and a slot keeps the run that arrives there first.  A run is given up once its
next arrival is later than the latest first arrival of all slots, which leaves the signature
unchanged.  Two documents agree in a slot with the probability of their probability Jaccard
similarity.  Documents that agree in all rows of a band share a bucket.

Pairs from buckets are verified on whole weighted sets, without any cap: first each member of a bucket
against the bucket's least member, then, within buckets that still hold more than one component,
every pair across components.  So the groups are the components of all pairs that share a bucket and reach
the threshold, whatever the size of a bucket.  Least members come from pre-aggregation, and the second round cuts a bucket
into blocks whose pairs are joined apart, so that no bucket and no group of equal texts needs a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import U, Words, batch_rows, columns, fresh, lists, mix, scratch, slices, stored, weighted
from chunkloom.llm.components import components

WORDS, BANDS, ROWS, THRESHOLD = 3, 30, 3, 0.45
#: Rows, of some 40 bytes each, of what is to be done that are sent to all tasks; beyond that, all rows move to meet them.
MOST_BROADCAST = 1 << 20
#: Members of a bucket that the second round joins with as many others at once.
BLOCK = 512


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """ProbMinHash of each text: (docs, slots) elements; rows of texts without elements hold 0."""
    first = np.full(docs * slots, np.inf)
    who = np.zeros(docs * slots, dtype=U)
    time = np.zeros(len(doc))
    seed = mix(element + U(0x1234567))
    turn = 0
    while len(doc):
        turn += 1
        r = mix(seed + U(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        time = time - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * slots + ((mix(r ^ U(0xA5A5A5A5)) >> U(32)) * U(slots) >> U(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        who[slot[won]] = element[won]
        latest = first.reshape(docs, slots).max(axis=1)
        on = time <= latest[doc]
        doc, element, weight, time, seed = doc[on], element[on], weight[on], time[on], seed[on]
    return who.reshape(docs, slots)


def buckets(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    h = np.broadcast_to(mix(np.arange(bands, dtype=U) + U(77)), (len(who), bands))
    for r in range(rows):
        h = mix(h * U(31) ^ mix(who[:, r::rows] + U(r)))
    return h.astype(np.int64)


def similarity(pair: np.ndarray, side: np.ndarray, element: np.ndarray, weight: np.ndarray, pairs: int) -> np.ndarray:
    """Probability Jaccard of each pair of weighted sets.

    For an element d in both, the sum over all elements e of max(x_e / x_d, y_e / y_d) takes x_e where
    x_e / y_e >= x_d / y_d and y_e otherwise, so elements sorted by ratio and their running sums give it.
    """
    order = np.lexsort((side, element, pair))
    pair, side, element, weight = pair[order], side[order], element[order], weight[order].astype(np.float64)
    same = np.zeros(len(pair), dtype=bool)
    same[1:] = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
    both = np.flatnonzero(same)
    x = np.where(side == 0, weight, 0.0)
    y = np.where(side == 1, weight, 0.0)
    y[both - 1] = y[both]
    keep = ~same
    pair, x, y = pair[keep], x[keep], y[keep]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.lexsort((ratio, pair))
    pair, x, y, ratio = pair[order], x[order], y[order], ratio[order]
    begin = np.searchsorted(pair, np.arange(pairs + 1))
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (ratio[1:] != ratio[:-1])
    tie = np.flatnonzero(new)[np.cumsum(new) - 1]
    cx, cy = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(y))
    common = (x > 0) & (y > 0)
    p, t = pair[common], tie[common]
    above = cx[begin[p + 1]] - cx[t]
    below = cy[t] - cy[begin[p]]
    return np.bincount(p, 1.0 / (above / x[common] + below / y[common]), minlength=pairs)


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column(1)):
            ids, w = b.column(0).slice(lo, hi - lo), Words(b.column(1).slice(lo, hi - lo))
            c1, c2 = w.content()
            doc, el, weight = weighted(*w.shingles(words))
            keys = buckets(signatures(doc, el, weight.astype(np.float64), hi - lo, bands * rows), bands, rows)
            some = w.counts > 0
            out = [ids.filter(pa.array(some)), pa.array(c1[some].astype(np.int64)), pa.array(c2[some].astype(np.int64)), lists(keys[some].ravel(), np.full(some.sum(), bands), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["id", "c1", "c2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column(1)):
            w = Words(b.column(1).slice(lo, hi - lo))
            doc, el, weight = weighted(*w.shingles(words))
            n = np.bincount(doc, minlength=hi - lo)
            out = [b.column(0).slice(lo, hi - lo), lists(el.astype(np.int64), n, pa.int64()), lists(weight, n, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["id", "els", "ws"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = sum(np.asarray(b.column(c).value_lengths().fill_null(0)) for c in ("els", "els_b")).cumsum()
        lo = 0
        while lo < len(b):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + most)))
            part = b.slice(lo, hi - lo)
            arrays = []
            for side, (e, w) in enumerate((("els", "ws"), ("els_b", "ws_b"))):
                n = np.asarray(part.column(e).value_lengths())
                arrays.append((np.repeat(np.arange(len(part)), n), np.full(n.sum(), side), part.column(e).flatten().to_numpy(), part.column(w).flatten().to_numpy()))
            s = similarity(*(np.concatenate(a) for a in zip(*arrays)), len(part))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s >= threshold)], ["a", "b", "ok"])
            lo = hi


def _verified(pairs: DataFrame, sets: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The pairs (a, b) with ``ok``: whether they reach the threshold."""
    other = sets.select(F.col("id").alias("b"), F.col("els").alias("els_b"), F.col("ws").alias("ws_b"))
    full = pairs.join(other, "b").join(sets.withColumnRenamed("id", "a"), "a").select("a", "b", "els", "ws", "els_b", "ws_b")
    with batch_rows(pairs.sparkSession, 512):
        return stored(full.mapInArrow(lambda it: _verify(it, threshold), f"a {kind}, b {kind}, ok boolean"), "verified")


def _across(members: DataFrame, block: int) -> DataFrame:
    """The pairs (a, b), a > b, of members (id, key, root) of a bucket with different roots.

    A bucket's members are spread over blocks by hash, and each pair of blocks is a join key of its own.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    cut = members.join(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
    cut = cut.withColumn("own", F.expr("cast(pmod(xxhash64(id, 31), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "id", "root")
    x, y = cut.where("not right").alias("x"), cut.where("right or lo = hi").alias("y")
    met = x.join(y, F.expr("x.key = y.key and x.lo = y.lo and x.hi = y.hi and x.root <> y.root and (x.lo < x.hi or x.id > y.id)"))
    return met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size) for each document of a group of two or more; keep_id is the group's least id.

    Rows with a null id or a text that is null or has no word are in no group.  Texts of fewer than
    ``words`` words have one shingle.  Copies that differ only in case, white space and punctuation are
    equal.  Rows that repeat an id are one document: whatever any of them resembles belongs to
    its group.  Other columns are not read.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = columns(docs, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    with scratch(docs.sparkSession):
        sketch = stored(texts.mapInArrow(lambda it: _sketch(it, words, bands, rows), f"id {kind}, c1 bigint, c2 bigint, keys array<bigint>"), "sketch")
        # Equal texts have equal keys: one of them stands for all.  Other texts of a repeated id stay.
        reps = sketch.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
        exact = stored(sketch.select("id", "c1", "c2").join(reps, ["c1", "c2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"), "c1", "c2").distinct(), "exact")
        one = sketch.join(exact.select(F.col("a").alias("id"), "c1", "c2"), ["id", "c1", "c2"], "left_anti")
        keyed = one.select("id", F.explode("keys").alias("key"))
        pivots = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top").drop("top")
        members = stored(keyed.join(pivots, "key").select("id", "key", "pivot"), "members")
        star = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        ids = members.select("id").distinct()
        sets = stored(texts.join(ids, "id", "left_semi").mapInArrow(lambda it: _sets(it, words), f"id {kind}, els array<bigint>, ws array<int>"), "sets")
        first = _verified(star, sets, kind, threshold)
        edges = exact.select("a", "b").unionByName(first.where("ok").select("a", "b"))
        roots = stored(components(edges), "components")
        # Buckets that still hold several components: all pairs across them.
        labelled = stored(members.join(roots, "id", "left").select("id", "key", F.coalesce("root", "id").alias("root")).distinct(), "labelled")
        second = _verified(_across(labelled, block).join(first.select("a", "b"), ["a", "b"], "left_anti"), sets, kind, threshold)
        more = second.where("ok").select("a", "b")
        if not more.isEmpty():
            roots = stored(components(edges.unionByName(more)), "components")
        sizes = roots.groupBy("root").agg(F.count("*").alias("group_size"))
        return stored(roots.join(sizes, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"), "group_size"), "near-text", lasts=True)


def _text(df: DataFrame, name: str) -> Column:
    """A column as a string that tells values apart; null stays null."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType.simpleString()
    return F.to_json(F.struct(c)) if kind.startswith(("map", "array", "struct", "variant")) else c.cast("string")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The table without near duplicates: of each group the document with the least id stays.

    All columns stay.  A document is an id with a text: different texts of a repeated id are documents of their own, of which those
    go that resemble a kept one.  Of rows that agree in id and text, one stays (the least by a hash of all columns).  Rows
    with a null id stay, except that of rows equal in all columns one stays; so do rows whose text is null or has no word.
    """
    unit, key, order, gone, least, equal = fresh(docs, "unit", "row_key", "row_order", "is_gone", "least_order", "n_equal")
    spark = docs.sparkSession
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    every = [_text(docs, c) for c in docs.columns]
    nulls = [F.concat(*(F.when(x.isNull(), "0").otherwise("1") for x in every))]
    whole = F.struct(F.xxhash64(*every, *nulls).alias("x"), F.xxhash64(F.lit(7), *every, *nulls).alias("y"))
    two = lambda *c: F.struct(F.xxhash64(*c).alias("x"), F.xxhash64(F.lit(7), *c).alias("y"))
    # What is to be done is worked out on keys alone; then the rows move once, to meet it.
    named = docs.select(i.alias("id"), F.xxhash64(t).alias("h"), t.alias("text")).where("id is not null")
    short = F.xxhash64("id", "h")
    # A document's 64-bit name, unless two documents have the same one: then its id and text hash are the name.
    check = named.select(short.alias("u"), "h", F.xxhash64(F.lit(99), "id").alias("g"))
    unlike = check.groupBy("u").agg((F.min("h") != F.max("h")).alias("x"), (F.min("g") != F.max("g")).alias("y")).where("x or y").isEmpty()
    name = short if unlike else F.struct("id", "h")
    with scratch(spark):
        groups = near_duplicates(named.select(name.alias(unit), "text"), id_col=unit, text_col="text", **how).select(F.col("doc_id").alias("u"), F.col("keep_id").alias("root"))
        members = groups.join(named.select(name.alias("u"), "id", "h").distinct(), "u")
        keep = members.groupBy("root").agg(F.min(F.struct("id", "h")).alias("keep"))
        drop = stored(members.join(keep, "root").where(F.struct("id", "h") != F.col("keep")).select(two("id", "h").alias(key), F.lit(True).alias(gone)), "gone", lasts=True)
    keyed = docs.withColumn(order, whole).withColumn(key, F.when(i.isNotNull(), two(i, F.xxhash64(t))).otherwise(F.col(order)))
    rows = keyed.groupBy(key, order).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("all"), F.min(F.struct(order, "n")).alias("first")).where(F.col("all") > 1)
    many = rows.select(key, F.col("first").getField(order).alias(least), F.col("first").getField("n").alias(equal))
    todo = stored(drop.unionByName(many.join(drop, key, "left_anti"), allowMissingColumns=True), "to-do")
    met = keyed.join(F.broadcast(todo) if todo.count() <= MOST_BROADCAST else todo, key, "left").where(F.col(gone).isNull() & (F.col(least).isNull() | (F.col(least) == F.col(order))))
    single = met.where(F.coalesce(F.col(equal), F.lit(1)) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    if todo.where(F.col(equal) > 1).isEmpty():
        return single
    # Rows equal in all columns: any one of them.
    again = met.where(F.col(equal) > 1).groupBy(key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return single.unionByName(again.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
