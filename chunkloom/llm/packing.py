"""Packing token sequences into training windows by Karmarkar-Karp multiway differencing.

A text longer than a window is cut into whole windows and a rest; nothing is dropped.  The rests and the shorter
texts are spread by hash over groups of about ``group_items`` each, and every group is packed on its own: each
item starts as a partial partition of its own; the two partial partitions with the largest
imbalances are merged so that the fullest part of one meets the emptiest of the other, until one is left.  It has as many parts as
the group has windows.  The number starts at its lower bound and rises by one whenever a part exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import columns, slices, stored
from chunkloom.llm.tokenizer import VOCABULARY, Vocabulary, ids

CAPACITY, GROUP_ITEMS = 4096, 256


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """A partition of the items into so many parts of near-equal sums; items are given by their numbers.

    Partial partitions hold their parts fullest first and leave out empty ones.  Ties go to the partial partition made first.
    """
    heap: list[tuple[int, int, list[int], list]] = []
    for i, s in enumerate(sizes):
        heap.append((-s if parts > 1 else 0, i, [s], [i]))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, sa, ta = heapq.heappop(heap)
        _, _, sb, tb = heapq.heappop(heap)
        over = len(sa) + len(sb) - parts
        if over <= 0:
            sums, trees = sa + sb, ta + tb
        else:
            # The last ``over`` parts of one meet the last ``over`` of the other, fullest with emptiest.
            ka, kb = len(sa) - over, len(sb) - over
            sums = sa[:ka] + sb[:kb] + [x + y for x, y in zip(sa[ka:], reversed(sb[kb:]))]
            trees = ta[:ka] + tb[:kb] + [(x, y) for x, y in zip(ta[ka:], reversed(tb[kb:]))]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, trees = [sums[k] for k in order], [trees[k] for k in order]
        least = sums[-1] if len(sums) == parts else 0
        heapq.heappush(heap, (least - sums[0], turn, sums, trees))
        turn += 1
    out = []
    for tree in heap[0][3] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity`` for items that are no larger; as few as differencing finds, counting up from the lower bound."""
    if not sizes:
        return []
    parts = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        windows = differencing(sizes, parts)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        parts += 1


def _kept_as(enc: tiktoken.Encoding) -> np.dtype:
    return np.dtype("<u2" if enc.max_token_value <= 65535 else "<u4")


def _tokens(blobs: pa.Array, kept_as: np.dtype) -> np.ndarray:
    """The tokens of pieces, one after another."""
    _, offsets, data = blobs.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].view(kept_as).astype(np.int32) if data is not None and len(off) else np.zeros(0, dtype=np.int32)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, size, ids): each row's tokens, cut every ``capacity`` tokens; a text without tokens has no piece.

    ``ids`` are bytes, little-endian, two a token if the vocabulary allows it, else four: a block of memory, not a list, to Spark.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoding()
        kept_as = _kept_as(enc)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                own = [ids(t.as_py(), enc) if t.is_valid else np.zeros(0, dtype=np.uint32) for t in part.column(1)]
                n = np.array([len(x) for x in own], dtype=np.int64)
                cuts = -(-n // capacity)
                row = np.repeat(np.arange(len(own)), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
                size = np.minimum(capacity, n[row] - start)
                at = pa.array(row)
                ends = np.append(0, np.cumsum(size * kept_as.itemsize)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(own).astype(kept_as))])
                out = [part.column(0).take(at), part.column(2).take(at), pa.array(start), pa.array(size), blobs]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "start", "size", "ids"])

    texts = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash bigint, start bigint, size bigint, ids binary")


def packed(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(window_group, window_no, n_tokens, token_ids, doc_ids, text_hashes, starts, lengths) for each window.

    ``token_ids`` are the window's tokens, piece after piece.  Piece i has lengths[i] of them; they are the tokens from starts[i] on of
    the document with id doc_ids[i] and text hash text_hashes[i], so that texts can be put together again from windows alone, even
    those of null and repeated ids.  Every token of every row is in exactly one window, no window exceeds ``capacity``.
    Rows without tokens (null or empty texts) are in none.  Repeated rows and repeated ids are packed as rows of their own, null ids
    are kept as null.  Whole windows of long texts have group -1 and number null.  Other columns are not read; an empty table gives no windows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cut = stored(pieces(docs, capacity, vocabulary, id_col, text_col), "pieces")
    kept_as = _kept_as(Vocabulary(vocabulary).encoding())
    schema = f"window_group bigint, window_no int, n_tokens bigint, token_ids array<int>, doc_ids array<{kind}>, text_hashes array<bigint>, starts array<bigint>, lengths array<bigint>"
    names = ["window_group", "window_no", "n_tokens", "token_ids", "doc_ids", "text_hashes", "starts", "lengths"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            one = lambda c: pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), b.column(c))  # noqa: E731, B023
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * capacity, pa.int32()), pa.array(_tokens(b.column("ids"), kept_as)))
            out = [pa.array(np.full(n, -1)), pa.nulls(n, pa.int32()), b.column("size"), tokens, one("doc_id"), one("text_hash"), one("start"), one("size")]
            yield pa.RecordBatch.from_arrays(out, names)

    full = cut.where(F.col("size") == capacity).mapInArrow(whole, schema)
    rests = cut.where(F.col("size") < capacity)
    groups = max(1, -(-rests.count() // group_items))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in tables:
            g = b.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[0].column("g")[0].as_py() != g[lo]:
                    yield solve(held)
                    held = []
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        sizes = t.column("size").to_numpy()
        windows = pack(sizes.tolist(), capacity)
        flat = np.array([i for w in windows for i in w], dtype=np.int64)
        off = np.append(0, np.cumsum([len(w) for w in windows]))
        took = t.take(pa.array(flat)).combine_chunks()
        lst = lambda c: pa.ListArray.from_arrays(pa.array(off, pa.int32()), took.column(c).combine_chunks())
        ends = np.append(0, np.cumsum(sizes[flat]))[off]
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_tokens(took.column("ids").combine_chunks(), kept_as)))
        n = len(windows)
        out = [pa.array([t.column("g")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(np.diff(ends)), tokens, lst("doc_id"), lst("text_hash"), lst("start"), lst("size")]
        return pa.RecordBatch.from_arrays(out, names)

    placed = rests.withColumn("g", F.expr(f"pmod(xxhash64(doc_id, text_hash, 7), {groups})")).repartition("g").sortWithinPartitions("g", F.desc("size"), "doc_id", "text_hash", "start")
    small = placed.mapInArrow(run, schema)
    return small.unionByName(full)
