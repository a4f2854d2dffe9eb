"""What the text operators share: Arrow batches as NumPy arrays, word hashes, shingles, shared tables.

Words are maximal runs of ASCII letters and digits or bytes above 0x7F in the
lower-cased UTF-8 text.  All hashing is vectorised over whole Arrow batches; no
Python code runs for each word.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.sources.tables import forget, place, scratch, stored

__all__ = ["forget", "place", "scratch", "stored"]
SLICE_BYTES = 1 << 20
#: ``weighted`` has 16 bits for a text's number.
SLICE_ROWS = 1 << 16
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b & (2**64 - 1), dtype=U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        got = _powers[base] = (out[0], out[1])
    return got


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
    """A hash of values[start:end] for each span, the same wherever the span lies."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values.astype(U) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text and at most ``rows`` texts; a longer text is a range of its own."""
    _, off = text_arrays(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


class Words:
    """Words of a slice of texts: ``start``/``end`` byte offsets, ``hash``, and ``first``, the
    number of the first word of each text (one entry more than texts)."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.data, self.off = text_arrays(pc.utf8_lower(column) if lower else column)
        n = len(self.data)
        w = _WORD[self.data]
        begins = w.copy()
        begins[1:] &= ~w[:-1]
        ends = w.copy()
        ends[:-1] &= ~w[1:]
        inner = self.off[(self.off > 0) & (self.off < n)]
        begins[inner] = w[inner]
        ends[inner - 1] = w[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.hash = span_hash(self.data + U(1), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def content(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each text's sequence of words."""
        a, b = self.first[:-1], self.first[1:]
        return span_hash(self.hash, a, b, _Q), span_hash(mix(self.hash ^ U(0x5BD1E995)), a, b, _P)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every run of k words; a text of fewer words is one shingle."""
        n = self.counts
        last = np.repeat(self.first[1:], n)
        doc = np.repeat(np.arange(len(n)), n)
        total = len(self.hash)
        out = self.hash * U(_Q)
        q = _Q
        at = np.arange(total)
        for j in range(1, k):
            q = q * _Q & (2**64 - 1)
            ok = at + j < last
            nxt = np.zeros(total, dtype=U)
            nxt[: total - j] = self.hash[j:] if j <= total else 0
            out += np.where(ok, nxt * U(q), U(0))
        keep = (at + k <= last) | (at == np.repeat(self.first[:-1], n))
        return doc[keep], mix(out[keep])


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, occurrences), sorted, of a slice of texts."""
    if len(doc) and int(doc.max()) >= SLICE_ROWS:
        raise ValueError(f"more than {SLICE_ROWS} texts in a slice")
    key = np.sort(doc.astype(U) << U(48) | h >> U(16))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), np.diff(np.append(at, len(new)))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of values."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, whatever else the table has."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def filesystem(uri: str):
    """(file system, path) for a URI or a local path, on the driver and in tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows an Arrow batch in what is run inside, for rows of kilobytes.  Other queries of the session that
    are planned meanwhile get batches of that size as well, which changes none of their results."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def attempt() -> str:
    """A name for this attempt of the task: no other attempt of it, or of another task, has it."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def tidy(folder: str, prefix: str, keep: set[str]) -> None:
    """Removes the files of a folder that begin so and are not to be kept: those of attempts whose result Spark didn't take."""
    from pyarrow import fs

    system, path = filesystem(folder)
    for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith(prefix) and f.base_name not in keep:
            system.delete_file(f.path)


def publish(uri: str, chunks: Iterator[bytes]) -> None:
    """Writes a file beside its place and moves it there, so that a lost or repeated task leaves no half file."""
    system, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    system.move(part, path)
