"""Where documents come from and chunks go to."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Paths that ``stored`` has written inside each open ``scratch`` of this thread, the innermost last.
_written: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("written", default=())
#: The folders of local sessions for which none is set.
_own: dict[str, str] = {}
FORMATS = ("parquet", "orc", "json", "csv", "text")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``, with its scheme; a local session without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, lasts: bool = False) -> DataFrame:
    """The table written to the shared folder and read again: later work doesn't repeat what made it.

    Inside a ``scratch`` it goes with it, or, if it ``lasts``, with the one around that.
    """
    spark = df.sparkSession
    df.write.parquet(at := place(spark, tag))
    for own in _written.get()[: -1 if lasts else None][-1:]:
        own.append(at)
    return spark.read.schema(df.schema).parquet(at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            _remove(df.sparkSession, f.rpartition("/")[0])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that this thread has stored inside."""
    token = _written.set((*_written.get(), []))
    try:
        yield
    finally:
        for at in _written.get()[-1]:
            _remove(spark, at)
        _written.reset(token)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they see that path; elsewhere ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")


def spread(df: DataFrame) -> DataFrame:
    """The table over all cores, where its Parquet files have fewer row groups than there are cores; as it is otherwise.

    A row group is read by one task, so that a table of one group would keep one core busy.  At most as many footers are read
    as there are cores, and a table that is shuffled here is no larger than that many row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores or not all(f.endswith(".parquet") for f in files):
        return df
    groups = 0
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        with system.open_input_file(path) as x:
            groups += pq.ParquetFile(x).metadata.num_row_groups
    return df if groups >= cores else df.repartition(cores)


def from_strings(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(doc_id, text); a document's id is its position.  An empty list is an error, as is anything but strings."""
    if not len(texts):
        raise ValueError("no documents")
    if not all(isinstance(t, str) for t in texts):
        raise TypeError("documents must be strings")
    return spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": list(texts)}), "doc_id bigint, text string")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"Invalid format: {format!r}")
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).format(format).load(path)


def write(chunks: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Chunks with their vectors in the same row; formats without arrays are refused by Spark."""
    if format not in FORMATS:
        raise ValueError(f"Invalid format: {format!r}")
    chunks.write.format(format).mode(mode).partitionBy(*partition_by).save(path)
