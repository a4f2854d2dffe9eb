"""Token ids as length-delimited binary records with a separate offset index.

A record is, little-endian: the payload's length (8 bytes), the masked CRC-32C of those 8 bytes (4), the payload, the
masked CRC-32C of the payload (4).  Masking turns the checksum right by 15 bits and adds 0xA282EAD8, so that data
that hold checksums of their own are safe.  The payload is: flags (1 byte; 1 no id, 2 no text, 4 token ids take four
bytes each, 8 the document's id is a string), the id (8; a string's length in bytes), the number of tokens (4), a string id's bytes,
the token ids (2 bytes each if the vocabulary allows it).

Every attempt of a task writes a shard of its own name and moves it into place when it is whole.  The index, a Parquet table
that Spark commits from one attempt a task, names that attempt's shard, so that shard and index always fit; shards of
attempts that were lost or lagged behind are removed at the end.  The vocabulary goes to the tasks with the job.
Readers visit records in any order by range reads and check every checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import attempt, columns, filesystem, place, publish, tidy
from chunkloom.llm.tokenizer import VOCABULARY, Vocabulary, encoding, ids

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_HEAD = np.dtype([("flags", "u1"), ("id", "<i8"), ("n", "<u4")])


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), dtype=np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0, t[k - 1] & 0xFF]
    return t


_T = _tables()
#: For two bytes at once: _T2[j, v] is what bytes 2j and 2j+1 of a word, read as v, add to the checksum.
_T2 = np.stack([_T[7 - 2 * j][np.arange(65536) & 255] ^ _T[6 - 2 * j][np.arange(65536) >> 8] for j in range(4)])


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each string of four bytes or more, all strings side by side, eight bytes a step.

    Strings are filled up with zero bytes in front, which leave a checksum of zero as it is; the starting value
    is added to the first four bytes instead.
    """
    size = np.array([len(p) for p in parts], dtype=np.int64)
    if not len(size):
        return np.zeros(0, dtype=np.uint32)
    if size.min() < 4:
        raise ValueError("four bytes at least")
    words = -(-size // 8)
    order = np.argsort(-words, kind="stable")
    buf = b"".join(x for i in order for x in (b"\0" * int(-size[i] % 8), parts[i]))
    data = np.frombuffer(bytearray(buf), dtype=np.uint8)
    words = words[order]
    start = np.append(0, np.cumsum(words)[:-1])
    at = (start * 8 + -size[order] % 8)[:, None] + np.arange(4)
    data[at] ^= 0xFF
    w = data.view("<u2").reshape(-1, 4)
    crc = np.zeros(len(size), dtype=np.uint32)
    longest = int(words[0])
    active = np.searchsorted(-words, -np.arange(1, longest + 1), side="right")  # strings of so many words or more
    for left in range(longest, 0, -1):
        n = active[left - 1]
        x = w[start[:n] + words[:n] - left]
        c = crc[:n]
        crc[:n] = _T2[0].take(x[:, 0] ^ (c & 0xFFFF)) ^ _T2[1].take(x[:, 1] ^ (c >> 16)) ^ _T2[2].take(x[:, 2]) ^ _T2[3].take(x[:, 3])
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = np.asarray(crc, dtype=np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The records, and the masked checksums of the payloads."""
    sizes = [np.uint64(len(p)).tobytes() for p in payloads]
    a, b = masked(crc32c(sizes)), masked(crc32c(payloads))
    return [s + x.tobytes() + p + y.tobytes() for s, x, p, y in zip(sizes, a, payloads, b)], b


def payload(doc_id: int | str | None, text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    enc = encoding(vocabulary)
    return _payload(doc_id, text, enc, enc.max_token_value > 65535)


def _payload(doc_id: int | str | None, text: str | None, enc, wide: bool) -> bytes:
    own = ids(text or "", enc)
    name = doc_id.encode("utf-8", "surrogatepass") if isinstance(doc_id, str) else b""
    head = np.zeros(1, dtype=_HEAD)
    head["flags"] = (doc_id is None) + 2 * (text is None) + 4 * wide + 8 * isinstance(doc_id, str)
    head["id"], head["n"] = len(name) if isinstance(doc_id, str) else doc_id or 0, len(own)
    return head.tobytes() + name + own.astype("<u4" if wide else "<u2").tobytes()


def parse(record: bytes) -> tuple[int | str | None, np.ndarray | None]:
    """(id, token ids) of a record; a wrong length or checksum is an error."""
    n = int(np.frombuffer(record[:8], "<u8")[0])
    if len(record) != n + 16:
        raise ValueError(f"a record of {len(record)} bytes says that its payload has {n}")
    body = record[12 : 12 + n]
    if masked(crc32c([record[:8]]))[0] != np.frombuffer(record[8:12], "<u4")[0] or masked(crc32c([body]))[0] != np.frombuffer(record[12 + n :], "<u4")[0]:
        raise ValueError("a checksum is wrong")
    head = np.frombuffer(body[: _HEAD.itemsize], _HEAD)[0]
    at = _HEAD.itemsize
    doc_id: int | str = int(head["id"])
    if head["flags"] & 8:
        doc_id, at = body[at : at + doc_id].decode("utf-8", "surrogatepass"), at + doc_id
    own = np.frombuffer(body[at:], "<u4" if head["flags"] & 4 else "<u2")
    if len(own) != head["n"]:
        raise ValueError("the number of tokens is wrong")
    return None if head["flags"] & 1 else doc_id, None if head["flags"] & 2 else own


def write_records(docs: DataFrame, out: str | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a record for every row and returns the index:
    (doc_id, shard, record, offset, length, n_tokens, checksum).

    ``out`` is a folder that all executors share (a new one in the session's checkpoint folder by default).
    A null text makes a record without tokens that says so, an empty text one with none; a null id
    is kept as null.  Ids of whole numbers take eight bytes, those of any other type are kept as Spark's string of them.  Repeated rows are repeated records.  Other columns are not read.  An empty table has an empty index.
    """
    spark = docs.sparkSession
    out = out or place(spark, "records")
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in _WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value.encoding()
        wide = enc.max_token_value > 65535
        shard = f"shard-{attempt()}.bin"
        rows: list[pa.RecordBatch] = []

        def chunks() -> Iterator[bytes]:
            at = number = 0
            for b in batches:
                for lo in range(0, len(b), 2048):
                    part = b.slice(lo, 2048)
                    bodies = [_payload(i, t.as_py(), enc, wide) for i, t in zip(part.column(0).to_pylist(), part.column(1))]
                    recs, sums = frames(bodies)
                    size = np.array([len(r) for r in recs], dtype=np.int64)
                    off = at + np.cumsum(size) - size
                    n = [int(np.frombuffer(p[9:13], "<u4")[0]) for p in bodies]
                    k = len(recs)
                    rows.append(pa.RecordBatch.from_arrays([part.column(0), pa.array([shard] * k, pa.string()), pa.array(np.arange(number, number + k)), pa.array(off), pa.array(size), pa.array(n, pa.int64()), pa.array(sums.astype(np.int64))], ["doc_id", "shard", "record", "offset", "length", "n_tokens", "checksum"]))
                    at, number = at + int(size.sum()), number + k
                    yield b"".join(recs)

        publish(f"{out}/{shard}", chunks())
        yield from rows

    stored_as = "bigint" if whole else "string"
    made = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast(stored_as), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {stored_as}, shard string, record bigint, offset bigint, length bigint, n_tokens bigint, checksum bigint")
    made = made.withColumn("doc_id", F.col("doc_id").cast(kind))
    made.write.parquet(f"{out}/index")
    index = spark.read.schema(made.schema).parquet(f"{out}/index")
    tidy(out, "shard-", {r.shard for r in index.select("shard").distinct().collect()})
    return index


def folder(index: DataFrame) -> str | None:
    """Where the records of an index are; None for an index without files."""
    files = index.inputFiles()
    return files[0].rpartition("/index/")[0] if files else None


def read_records(index: DataFrame, out: str | None = None, seed: int | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) of the records that the index names, checked; with a seed in a shuffled order.

    The order is one of all records: a sort by a hash of seed, shard and number.
    """
    out = out or folder(index)
    rows = index.select("shard", "record", "offset", "length")
    kind = index.schema["doc_id"].dataType.simpleString()
    if seed is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "shard", "record"), "shard", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for b in batches:
            got = []
            for shard, at, size in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard not in files:
                    system, path = filesystem(f"{out}/{shard}")
                    files[shard] = system.open_input_file(path)
                got.append(parse(files[shard].read_at(size, at)))
            n = [0 if t is None else len(t) for _, t in got]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64() if kind in _WHOLE else pa.string()), pa.array([None if t is None else t.astype(np.int64) for _, t in got], pa.list_(pa.int64())), pa.array(n, pa.int64())], ["doc_id", "ids", "n_tokens"])

    got = rows.mapInArrow(run, f"doc_id {'bigint' if kind in _WHOLE else 'string'}, ids array<bigint>, n_tokens bigint")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))
