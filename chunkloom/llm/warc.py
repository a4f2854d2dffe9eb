"""WARC archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own.  The captures' index lines are sorted by URL key (host
labels reversed, then the path) and cut into compressed blocks of ``block_lines`` lines; a directory has each block's first key,
file, offset and length and is itself sorted.  A look-up binary-searches the directory, reads only the blocks that may
hold the key, and reads the record by a range read.

The index is range-partitioned: a shard of blocks has its own small directory file, and only the first key of each shard is
gathered.  A look-up task opens the directories of those shards that its sorted keys fall in, so no
process ever holds the whole directory.  Every attempt of a task writes files of its own name, which appear when they are whole; the tables that
Spark commits name those of the attempt that it took, and the others are removed.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import attempt, columns, filesystem, place, publish, tidy

BLOCK_LINES, DATE = 300, "2024-01-01T00:00:00Z"
#: Bytes of records that a look-up task fetches when all of an archive is wanted.
FETCH_BYTES = 128 << 20


def url_key(url: Column) -> Column:
    """The sort key: ``com,example,www)/path?query``.  Scheme, user, port of the scheme, fragment and case of the host don't count;
    null for what isn't an absolute URL."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]*)?([^#]*)"
    at = lambda n: F.regexp_extract(url, parts, n)
    host = F.array_join(F.reverse(F.split(F.lower(at(2)), "[.]")), ",")
    scheme, port = F.lower(at(1)), at(3)
    usual = (port == "") | (port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    path = F.when(at(4).startswith("/"), at(4)).otherwise(F.concat(F.lit("/"), at(4)))
    return F.when(url.rlike(parts), F.concat(host, F.when(usual, "").otherwise(port), F.lit(")"), path))


ORACLE_KEY = r"""
    CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+') THEN
      array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')), ',')
      || CASE WHEN regexp_matches(url, '^(?i:http)://(?:[^/?#@]*@)?[^/?#:]+(?::80|:)?(?:[/?#]|$)') OR regexp_matches(url, '^(?i:https)://(?:[^/?#@]*@)?[^/?#:]+(?::443|:)?(?:[/?#]|$)')
              THEN '' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(:[0-9]*)?', 1) END
      || ')' || CASE WHEN starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)', 1), '/') THEN '' ELSE '/' END
      || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)', 1)
    END"""


def record(page_id: str | None, url: str, html: str | None) -> tuple[bytes, str]:
    """(gzip member, payload digest) of a page; a null page is a record without payload that says so."""
    body = (html or "").encode("utf-8", "surrogatepass")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    extra = "".join(f"{k}: {v}\r\n" for k, v in (("X-Page-ID", page_id if page_id is None else quote(str(page_id), errors="surrogatepass")), ("X-Null-Payload", html is None or None)) if v is not None)
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {clean}\r\nWARC-Payload-Digest: {digest}\r\nContent-Type: text/html\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + z.flush(), digest


def parse(member: bytes) -> dict:
    """Headers (lower-case names) and ``body`` of a record; a wrong length or digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(out["content-length"])
    body = rest[:n]
    if len(body) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    digest = out.get("warc-payload-digest")
    if digest and digest.startswith("sha1:") and digest != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise ValueError("the record's digest is wrong")
    out["body"] = body
    return out


class Archive:
    """A folder of WARC files with its index.  ``shards``: (first key, name) of each shard of blocks, sorted; ``size``: bytes of all records; ``kind``: the type of page ids, which the files have as strings."""

    def __init__(self, folder: str, shards: list[tuple[str, str]], captures: int, size: int, kind: str = "bigint"):
        self.folder, self.shards, self.captures, self.size, self.kind = folder, shards, captures, size, kind


def write_archive(pages: DataFrame, out: str | None = None, block_lines: int = BLOCK_LINES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Writes every page with an absolute URL and the index of all captures.

    ``out`` is a folder that all executors share (a new one in the session's checkpoint folder by default).  Pages
    whose URL is null or not absolute have no key and are left out.  Repeated pages are captures of
    their own.  A null page id and a null page are kept as such.  Other columns are not read.
    """
    spark = pages.sparkSession
    out = out or place(spark, "warc")
    rows = columns(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").select(F.col("page_id").cast("string"), "url", "html", url_key(F.col("url")).alias("key")).where("key is not null")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"data-{attempt()}.warc.gz"
        made: list[pa.RecordBatch] = []

        def members() -> Iterator[bytes]:
            at = 0
            for b in batches:
                ids, off, size, digests = b.column(0), [], [], []
                for i, u, h in zip(b.column(0), b.column(1), b.column(2)):
                    data, digest = record(i.as_py(), u.as_py(), h.as_py())
                    off.append(at)
                    size.append(len(data))
                    digests.append(digest)
                    at += len(data)
                    yield data
                made.append(pa.RecordBatch.from_arrays([b.column(3), ids, b.column(1), pa.array([name] * len(b), pa.string()), pa.array(off, pa.int64()), pa.array(size, pa.int64()), pa.array(digests, pa.string())], ["key", "page_id", "url", "file", "offset", "length", "digest"]))

        publish(f"{out}/{name}", members())
        yield from made

    made = rows.mapInArrow(store, "key string, page_id string, url string, file string, offset bigint, length bigint, digest string")
    made.write.parquet(f"{out}/captures")
    captures = spark.read.schema(made.schema).parquet(f"{out}/captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{attempt()}"
        directory: list[tuple[str, int, int, int]] = []
        total = held = 0

        def blocks() -> Iterator[bytes]:
            nonlocal total, held
            lines: list[str] = []
            first, at = "", 0

            def block() -> bytes:
                nonlocal at
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress("".join(lines).encode("utf-8", "surrogatepass")) + z.flush()
                directory.append((first, at, len(data), len(lines)))
                at += len(data)
                lines.clear()
                return data

            for b in batches:
                for key, *rest in zip(*(c.to_pylist() for c in b.columns)):
                    if not lines:
                        first = key
                    lines.append(json.dumps([key, *rest]) + "\n")
                    total += 1
                    held += rest[4]
                    if len(lines) == block_lines:
                        yield block()
            if lines:
                yield block()

        publish(f"{out}/{name}.cdx.gz", blocks())
        if directory:
            publish(f"{out}/{name}.dir", iter([_directory(directory)]))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([total]), pa.array([held])], ["first", "name", "lines", "size"])

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    made_index = ordered.mapInArrow(index, "first string, name string, lines bigint, size bigint")
    made_index.write.parquet(f"{out}/shards")
    shards = sorted(map(tuple, spark.read.schema(made_index.schema).parquet(f"{out}/shards").collect()))
    tidy(out, "data-", {r.file for r in captures.select("file").distinct().collect()})
    tidy(out, "index-", {n + end for _, n, _, _ in shards for end in (".cdx.gz", ".dir")})
    return Archive(out, [(f, n) for f, n, _, _ in shards], sum(s[2] for s in shards), sum(s[3] for s in shards), pages.schema[id_col].dataType.simpleString())


def _directory(rows: list[tuple[str, int, int, int]]) -> bytes:
    """Sorted fixed-width entries behind their number, then the keys: binary search needs no parsing."""
    keys = [r[0].encode("utf-8", "surrogatepass") for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    table = np.array([(e - len(k), len(k), *r[1:]) for e, k, r in zip(ends, keys, rows)], dtype="<i8")
    return np.int64(len(rows)).tobytes() + table.tobytes() + b"".join(keys)


class Directory:
    def __init__(self, raw: bytes):
        n = int(np.frombuffer(raw[:8], "<i8")[0])
        self.table = np.frombuffer(raw[8 : 8 + n * 40], "<i8").reshape(n, 5)
        self.keys = raw[8 + n * 40 :]

    def __len__(self) -> int:
        return len(self.table)

    def __getitem__(self, i: int) -> bytes:
        a, n = self.table[i, :2]
        return self.keys[a : a + n]

    def blocks(self, key: bytes) -> range:
        """The blocks that may hold the key: from the last that begins below it to the last that begins with it."""
        return range(max(0, bisect.bisect_left(self, key) - 1), bisect.bisect_right(self, key))


class Reader:
    """Look-ups in an archive; keeps the open files, the last directory and the last blocks."""

    def __init__(self, archive: Archive):
        self.archive = archive
        self.firsts = [f.encode("utf-8", "surrogatepass") for f, _ in archive.shards]
        self.files: dict = {}
        self.directory: tuple[str, Directory] | None = None
        self.block: dict[tuple[str, int], list[list]] = {}
        self.range_reads = 0

    def _file(self, name: str):
        if name not in self.files:
            system, path = filesystem(f"{self.archive.folder}/{name}")
            self.files[name] = system.open_input_file(path)
        return self.files[name]

    def captures(self, key: str) -> list[list]:
        """Index lines of the key: [key, page_id, url, file, offset, length, digest]."""
        k = key.encode("utf-8", "surrogatepass")
        out = []
        for s in range(max(0, bisect.bisect_left(self.firsts, k) - 1), bisect.bisect_right(self.firsts, k)):
            name = self.archive.shards[s][1]
            if self.directory is None or self.directory[0] != name:
                self.directory = name, Directory(self._file(f"{name}.dir").read_at(self._file(f"{name}.dir").size(), 0))
            d = self.directory[1]
            for i in d.blocks(k):
                if (name, i) not in self.block:
                    if len(self.block) > 3:
                        self.block.pop(next(iter(self.block)))
                    _, _, at, size, _ = d.table[i].tolist()
                    self.range_reads += 1
                    raw = zlib.decompress(self._file(f"{name}.cdx.gz").read_at(size, at), 31)
                    self.block[name, i] = [json.loads(x) for x in raw.decode("utf-8", "surrogatepass").splitlines() if x]
                lines = self.block[name, i]
                out += lines[bisect.bisect_left(lines, k, key=lambda x: x[0].encode("utf-8", "surrogatepass")) : bisect.bisect_right(lines, k, key=lambda x: x[0].encode("utf-8", "surrogatepass"))]
        return out

    def fetch(self, file: str, offset: int, length: int) -> dict:
        return parse(self._file(file).read_at(length, offset))


def look_up(archive: Archive, keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """(urlkey, page_id, url, html) for every capture of each distinct key of the one-column table; unknown and null keys give no rows.

    Keys are a small part of what a task reads, so the number of tasks is set (the session's shuffle partitions by default) and not left to the size of the keys.
    """
    tasks = tasks or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key in b.column(0).to_pylist():
                for _, page_id, url, file, offset, length, _ in reader.captures(key):
                    rec = reader.fetch(file, offset, length)
                    html = None if "x-null-payload" in rec else rec["body"].decode("utf-8", "surrogatepass")
                    rows.append((key, page_id, url, html))
                    held += len(rec["body"])
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string()))], ["urlkey", "page_id", "url", "html"])

    one = keys.toDF("key").where("key is not null").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return one.mapInArrow(run, "urlkey string, page_id string, url string, html string").withColumn("page_id", F.col("page_id").cast(archive.kind))


def read_warc(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(file, offset, page_id, url, digest, html) of every record of WARC files with a gzip member a record, read as a stream; page ids are cast to ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, where = filesystem(name)
                with system.open_input_stream(where, compression=None) as f:
                    z, raw, member, at, begin = zlib.decompressobj(31), b"", [], 0, 0
                    while True:
                        if not raw:
                            raw = f.read(1 << 20)
                            if not raw:
                                break
                        member.append(raw)
                        z.decompress(raw)
                        if z.eof:
                            rest = z.unused_data
                            member[-1] = raw[: len(raw) - len(rest)]
                            data = b"".join(member)
                            rec = parse(data)
                            page = rec.get("x-page-id")
                            page = page if page is None else unquote(page, errors="surrogatepass")
                            html = None if "x-null-payload" in rec else rec["body"].decode("utf-8", "surrogatepass")
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([begin], pa.int64()), pa.array([page], pa.string()), pa.array([rec["warc-target-uri"]]), pa.array([rec.get("warc-payload-digest")], pa.string()), pa.array([html], pa.string())], ["file", "offset", "page_id", "url", "digest", "html"])
                            at += len(data)
                            z, raw, member, begin = zlib.decompressobj(31), rest, [], at
                        else:
                            raw = b""
                    if member:
                        raise ValueError(f"{name} ends within a record")

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, "file string, offset bigint, page_id string, url string, digest string, html string").withColumn("page_id", F.col("page_id").cast(kind))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """(page_id, url, urlkey, html_chars, html_md5) of each page, archived and fetched again by its key through the index."""
    archive = write_archive(pages, **how)
    keys = columns(pages, how.get("url_col", "url")).toDF("url").select(url_key(F.col("url")))
    got = look_up(archive, keys, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-archive.size // FETCH_BYTES)))
    return got.select("page_id", "url", "urlkey", F.length("html").cast("bigint").alias("html_chars"), F.md5("html").alias("html_md5"))
