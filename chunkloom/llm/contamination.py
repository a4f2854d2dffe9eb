"""Benchmark decontamination: containment search with size-partitioned MinHash, verified exactly.

A text is the set of its runs of ``words`` words.  Documents are partitioned by the power of two that their set's
size falls in; a partition has its own number of bins, and a document's sketch keeps the least hash of each
bin.  A test item is sketched once for each partition, with that partition's bins, and is a candidate for the documents
that share a bin's least hash with it.  Bins are so many that an item that just reaches the
threshold is missed with probability ``miss`` at most, however long the document is: the
number follows from the smallest item.  Candidates are verified on the exact sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import U, Words, columns, fresh, lists, scratch, slices, stored, weighted

WORDS, THRESHOLD, MISS = 5, 0.7, 0.005
#: Beyond so many shingles of test items, sketches meet in a shuffled join and nothing is broadcast.
MOST_BROADCAST = 1 << 21


def bin_load(smallest: int, threshold: float, miss: float) -> float:
    """Elements a bin, such that of ceil(threshold * smallest) elements none being a bin's least has probability ``miss``."""
    need = 1 - miss ** (1 / max(1, math.ceil(threshold * smallest)))
    lo, hi = 1e-3, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if -math.expm1(-mid) / mid > need else (lo, mid)
    return lo


def partition_bits(size: np.ndarray, load: float) -> np.ndarray:
    """log2 of the number of bins for sets of these sizes; it is also the partition's number."""
    top = np.floor(np.log2(np.maximum(size, 1))) + 1
    return np.clip(np.ceil(top - math.log2(load)), 0, 47).astype(np.int64)


def sketch(doc: np.ndarray, el: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the sorted elements are the least of their document's bin."""
    bin_of = el >> (U(48) - bits.astype(U))
    out = np.ones(len(el), dtype=bool)
    out[1:] = (doc[1:] != doc[:-1]) | (bin_of[1:] != bin_of[:-1])
    return out


class Items:
    """Test items as sets, with a sketch index for each partition, made when first needed."""

    def __init__(self, number: np.ndarray, el: np.ndarray, threshold: float, miss: float):
        self.number, self.el, self.threshold = number, el, threshold
        self.size = np.bincount(number) if len(number) else np.zeros(0, dtype=np.int64)
        self.load = bin_load(int(self.size[self.size > 0].min()) if len(number) else 1, threshold, miss)
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        order = np.argsort(el, kind="stable")
        self.by_el, self.by_el_number = el[order], number[order]

    def at(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        if bits not in self.index:
            own = sketch(self.number, self.el, np.full(len(self.el), bits))
            order = np.argsort(self.el[own], kind="stable")
            self.index[bits] = self.el[own][order], self.number[own][order]
        return self.index[bits]

    def find(self, doc: np.ndarray, el: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, shared elements) of the pairs that reach the threshold."""
        none = np.zeros(0, dtype=np.int64)
        if not len(el) or not len(self.el):
            return none, none, none
        bits = partition_bits(np.bincount(doc, minlength=docs), self.load)
        least = sketch(doc, el, bits[doc])
        known = _member(el, self.by_el)
        hit = least & known
        found = []
        for p in np.unique(bits[doc[hit]]):
            own = hit & (bits[doc] == p)
            d, n = _matches(doc[own], el[own], *self.at(int(p)))
            found.append(d * len(self.size) + n)
        cand = np.unique(np.concatenate(found)) if found else none
        if not len(cand):
            return none, none, none
        wanted = np.isin(doc, cand // len(self.size)) & known
        d, n = _matches(doc[wanted], el[wanted], self.by_el, self.by_el_number)
        pair, shared = np.unique(d * len(self.size) + n, return_counts=True)
        ok = np.isin(pair, cand) & (shared >= self.threshold * self.size[pair % len(self.size)] - 1e-9)
        return pair[ok] // len(self.size), pair[ok] % len(self.size), shared[ok]


def _member(el: np.ndarray, sorted_el: np.ndarray) -> np.ndarray:
    """Whether each element is in the sorted array; a bitmap of the low bits turns most away."""
    bits = min(24, max(10, int(len(sorted_el) - 1).bit_length() + 5))
    low = np.zeros(1 << bits, dtype=bool)
    low[(sorted_el & U((1 << bits) - 1)).astype(np.int64)] = True
    out = low[(el & U((1 << bits) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    pos = np.minimum(np.searchsorted(sorted_el, el[at]), len(sorted_el) - 1)
    out[at] = sorted_el[pos] == el[at]
    return out


def _matches(doc: np.ndarray, el: np.ndarray, sorted_el: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item number) for every equal element."""
    lo, hi = np.searchsorted(sorted_el, el, "left"), np.searchsorted(sorted_el, el, "right")
    n = hi - lo
    at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return np.repeat(doc, n), number[at]


def _shingled(b: pa.RecordBatch, at: int, words: int):
    for lo, hi in slices(b.column(at)):
        doc, el, _ = weighted(*Words(b.column(at).slice(lo, hi - lo)).shingles(words))
        yield lo, hi, doc, el


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, doc, el in _shingled(b, 1, words):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists(el.astype(np.int64), np.bincount(doc, minlength=hi - lo), pa.int64())], ["id", "els"])


def _items(benchmark: DataFrame, words: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, els): the set of each item; repeated ids with different texts are different items of that id."""
    kind = benchmark.schema[item_col].dataType.simpleString()
    b = columns(benchmark, item_col, text_col).toDF("id", "text").where("text is not null").distinct()
    return b.mapInArrow(lambda it: _sets(it, words), f"id {kind}, els array<bigint>").where("size(els) > 0")


def _broadcast(items: DataFrame, threshold: float, miss: float, most: int):
    """(ids, Items) if the items have at most so many shingles, else None."""
    total = items.agg(F.sum(F.size("els"))).first()[0] or 0
    if total > most:
        return None
    rows = items.collect()
    n = [len(r.els) for r in rows]
    el = np.array([x for r in rows for x in r.els], dtype=np.int64).astype(U)
    return [r.id for r in rows], Items(np.repeat(np.arange(len(rows)), n), el, threshold, miss)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, most: int = MOST_BROADCAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that holds at least ``threshold`` of an item.

    Null or wordless texts and items match nothing; an item of fewer than ``words`` words is one
    shingle and is found only as a whole text.  Each row of the documents is searched on its own, so
    repeated rows give repeated results and a null doc_id is reported as null.  Other columns are not read.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = columns(docs, id_col, text_col).toDF("id", "text").where("text is not null")
    with scratch(spark):
        items = stored(_items(benchmark, words, item_col, "text"), "items")
        got = _broadcast(items, threshold, miss, most)
        found = None if got is not None else stored(_joined(texts, items, words, threshold, miss, kind), "contaminated", lasts=True)
    out_type = f"doc_id {kind}, item_id {item_kind}, n_shared bigint, n_item bigint"
    if got is not None:
        shared = spark.sparkContext.broadcast(got)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, known = shared.value
            name = pa.array(ids)
            for b in batches:
                for lo, hi, doc, el in _shingled(b, 1, words):
                    d, n, s = known.find(doc, el, hi - lo)
                    if len(d):
                        out = [b.column(0).slice(lo, hi - lo).take(pa.array(d)), name.take(pa.array(n)), pa.array(s), pa.array(known.size[n])]
                        yield pa.RecordBatch.from_arrays(out, ["doc_id", "item_id", "n_shared", "n_item"])

        found = texts.mapInArrow(search, out_type)
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def _joined(texts: DataFrame, items: DataFrame, words: int, threshold: float, miss: float, kind: str) -> DataFrame:
    """The same by shuffled joins, for item sets of any size.  Rows of documents are told apart by id and text hash."""
    small = items.agg(F.min(F.size("els"))).first()[0]
    load = bin_load(small, threshold, miss)
    keyed = texts.groupBy("id", "text").agg(F.count("*").alias("copies")).select(F.struct("id", F.xxhash64("text").alias("h"), F.expr("crc32(text)").alias("c"), "copies").alias("key"), "text")
    key = f"struct<id: {kind}, h: bigint, c: bigint, copies: bigint>"

    def docs_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, el in _shingled(b, 1, words):
                bits = partition_bits(np.bincount(doc, minlength=hi - lo), load)[doc]
                own = sketch(doc, el, bits)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc[own])), pa.array(bits[own]), pa.array(el[own].astype(np.int64))], ["key", "part", "el"])

    marks = stored(keyed.mapInArrow(docs_sketch, f"key {key}, part bigint, el bigint"), "marks")
    parts = [r.part for r in marks.select("part").distinct().collect()]

    def items_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(1).value_lengths())
            doc, el = np.repeat(np.arange(len(b)), n), b.column(1).flatten().to_numpy().astype(U)
            for p in parts:
                own = sketch(doc, el, np.full(len(el), p))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[own])), pa.array(np.full(own.sum(), p)), pa.array(el[own].astype(np.int64))], ["item", "part", "el"])

    numbered = items.withColumn("item", F.struct("id", F.xxhash64("els").alias("h")))
    item_kind = numbered.schema["item"].dataType.simpleString()
    probes = numbered.select("item", "els").mapInArrow(items_sketch, f"item {item_kind}, part bigint, el bigint")
    cand = stored(marks.join(probes, ["part", "el"]).select("key", "item").distinct(), "candidates")
    sets = keyed.join(cand.select("key").distinct(), "key", "left_semi").mapInArrow(lambda it: _sets(it, words), f"id {key}, els array<bigint>").select(F.col("id").alias("key"), F.col("els").alias("doc_els"))
    both = cand.join(sets, "key").join(numbered.select("item", "els"), "item")
    full = both.select("key", "item", F.size(F.array_intersect("doc_els", "els")).cast("bigint").alias("n_shared"), F.size("els").cast("bigint").alias("n_item"))
    full = full.where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    rows = full.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("key.copies"))))
    return rows.select(F.col("key.id").alias("doc_id"), F.col("item.id").alias("item_id"), "n_shared", "n_item")


def decontaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, most: int = MOST_BROADCAST, text_col: str = "text") -> DataFrame:
    """The rows of the table that hold no test item; all columns stay.  Rows without text stay."""
    spark = docs.sparkSession
    with scratch(spark):
        items = stored(_items(benchmark, words, "item_id", "text"), "items")
        got = _broadcast(items, threshold, miss, most)
        if got is None:
            (mark,) = fresh(docs, "mark")
            t = F.col(f"`{text_col}`")
            texts = docs.select(F.xxhash64(t).alias("id"), t.alias("text")).where("text is not null")
            bad = stored(_joined(texts, items, words, threshold, miss, "bigint").select(F.col("doc_id").alias(mark)).distinct(), "contaminated", lasts=True)
    if got is None:
        return docs.join(bad, F.xxhash64(t) == F.col(mark), "left_anti")
    shared = spark.sparkContext.broadcast(got)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[1]
        for b in batches:
            keep = np.ones(len(b), dtype=bool)
            for lo, hi, doc, el in _shingled(b, at, words):
                d, _, _ = known.find(doc, el, hi - lo)
                keep[lo + d] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


#: All pairs compared on exact sets.  ASCII letters and digits and everything above are words, as in ``common``.
ORACLE = f"""
    WITH texts AS (
        SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
    ), worded AS (
        SELECT side, id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM texts WHERE text IS NOT NULL
    ), shingled AS (
        SELECT DISTINCT side, id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS s
        FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
    ), sizes AS (SELECT id, count(*) AS n FROM shingled WHERE side = 1 GROUP BY id)
    SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(z.n) AS n_item, round(count(*) / any_value(z.n), 6) AS containment
    FROM shingled d JOIN shingled b ON d.side = 0 AND b.side = 1 AND d.s = b.s JOIN sizes z ON z.id = b.id
    GROUP BY d.id, b.id HAVING count(*) >= {THRESHOLD} * any_value(z.n)"""
