"""What a Python worker holds of one of Spark's batches, which have up to 10,000 rows."""

import inspect
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.api import LateChunker
from chunkloom.config import ChunkConfig, Options
from chunkloom.operators import chunks as ch
from chunkloom.operators import text as tx

WORDS = "Alpha beta gamma. Delta 12 and e! "
SIZES = [k % 20 for k in range(10_000)]
MB = 1 << 20


@pytest.fixture
def caught(monkeypatch):
    """Python functions that were made Arrow functions, the last one last."""
    found, real = [], F.arrow_udf

    def spy(f, *rest, **how):
        if not callable(f):
            return lambda g: spy(g, f, *rest, **how)
        found.append(f)
        return real(f, *rest, **how)

    monkeypatch.setattr(F, "arrow_udf", spy)
    return found


def ran(f, *columns):
    """(parts of the result, MB that Python and Arrow held beside input and result at most)."""
    tracemalloc.start()
    out = []
    most, before = 0, pa.total_allocated_bytes()
    many = f(iter([columns if len(columns) > 1 else columns[0]])) if inspect.isgeneratorfunction(f) else [f(*columns)]
    for x in many:
        most = max(most, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before)
        out.append(x.slice(0))
        before = pa.total_allocated_bytes()
    tracemalloc.stop()
    return out, most / MB


def test_tokens_of_a_large_batch_are_made_in_slices(spark, caught):
    tx.tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    parts, mb = ran(caught[-1], pa.array([WORDS * n if n else None for n in SIZES]))
    assert mb < 64 and [n for p in parts for n in p.value_lengths().to_pylist()] == [7 * n for n in SIZES]
    last, at = parts[-1][-1].as_py(), 18 * len(WORDS)
    assert [(t["token"], t["start"] - at, t["end"] - at, t["sent_id"]) for t in last[-3:]] == [("12", 24, 26, 37), ("and", 27, 30, 37), ("e", 31, 32, 37)]
    assert all(t["sent_id"] == k // 7 * 2 + (k % 7 > 2) for k, t in enumerate(last))


def test_places_of_a_large_batch_are_made_in_slices(spark, caught):
    tx.locate_tokens(F.col("text"))
    parts, mb = ran(caught[-1], pa.array([WORDS * n if n else None for n in SIZES]))
    assert mb < 64 and [n for p in parts for n in p.value_lengths().to_pylist()] == [7 * n for n in SIZES]
    assert [tuple(t.values()) for t in parts[-1][-1].as_py()[-2:]] == [("and", 18 * len(WORDS) + 27, 18 * len(WORDS) + 30), ("e", 18 * len(WORDS) + 31, 18 * len(WORDS) + 32)]


def test_sentences_of_a_large_batch_are_made_in_slices(spark, caught):
    tx.segment(F.col("text"))
    parts, mb = ran(caught[-1], pa.array(["Ab. " * 10 * n if n else None for n in SIZES]))
    assert mb < 64 and [n for p in parts for n in p.value_lengths().to_pylist()] == [10 * n for n in SIZES]
    assert list(parts[-1][-1].as_py()[-1].values()) == [756, 759, "Ab."]


def test_slices_join_to_the_batch(spark, monkeypatch):
    from chunkloom.operators import slices

    texts = [(k, None if k % 7 == 3 else WORDS * (k % 5)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)

    def made():
        return [tx.tokens(df, prompt="find: ").collect(), tx.sentences(df, "regex-abbrev").collect(), df.select(tx.locate_tokens(F.col("text"))).collect()]

    whole = made()
    for most in (1, 100, 300):
        monkeypatch.setattr(slices, "SLICE", most)
        assert made() == whole


def test_ranges():
    from chunkloom.operators.slices import ranges

    a, b = pa.array(["", None, "abcdef", "é", "x" * 50]).slice(1), pa.array([[1], None, [1, 2], []], pa.list_(pa.int32()))
    assert list(ranges([a], [1], 1, 8)) == [(0, 2), (2, 3), (3, 4)]
    assert list(ranges([a, b], [0, 1], 1, 4)) == [(0, 2), (2, 4)]
    assert list(ranges([a.slice(0, 0)], [1], 1, 4)) == []
    assert [hi - lo for lo, hi in ranges([pa.array(["x"] * 100)], [1], 0, 7)] == [7] * 14 + [2]


def test_chunks_of_a_large_batch_are_made_in_slices(spark, caught):
    plan = ch.Plan([ChunkConfig(1), ChunkConfig(3)], 1 << 30, prechunk=False, keep_tail=True)
    ch.embedded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), plan, Options())
    sizes = [k % 40 for k in range(10_000)]
    counts = pa.array([[3] * n if n else None for n in sizes], pa.list_(pa.int32()))
    hashes = pa.array([[7 + k, 5, 6] * n if n else None for k, n in enumerate(sizes)], pa.list_(pa.int64()))
    parts, mb = ran(caught[-1], hashes, counts)
    assert mb < 64 and [n for p in parts for n in p.value_lengths().to_pylist()] == [n + -(-n // 3) for n in sizes]
    last = parts[-1][-1].as_py()
    assert [(c["config_no"], c["first_sent"], c["last_sent"], c["n_tokens"]) for c in last[-2:]] == [(1, 33, 35, 9), (1, 36, 38, 9)] and len({tuple(c["embedding"]) for c in last}) == 1


def test_slices_of_chunks_join_to_the_batch(spark, monkeypatch):
    from chunkloom.operators import slices

    texts = [(k, None if k % 7 == 3 else WORDS * (k % 5)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)

    def made():
        late = LateChunker()
        prompted = late.encode(df, max_chunk_sents=2, prechunk=False, prompt="search document: ").collect()
        three = late.encode(df, max_length=16, max_chunk_sents=[1, 2, 3]).collect()
        counts = df.select(F.expr("transform(sequence(0, cast(doc_id as int)), i -> i % 9)").alias("c"))
        plain = counts.select(ch.greedy_chunks(F.col("c"), 10, 3, 1), ch.packed_sequences(F.col("c"), 12)).collect()
        return [prompted, three, plain, late.encode_queries(df, id_col="doc_id").collect()]

    whole = made()
    for most in (1, 1000):
        monkeypatch.setattr(slices, "SLICE", most)
        assert made() == whole


def pooled(spark, caught, plan):
    """(chunks of each of 10,000 documents of k % 40 sentences, MB)."""
    ch.embedded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), plan, Options())
    sizes = [k % 40 for k in range(10_000)]
    parts, mb = ran(caught[-1], pa.array([[7, 5, 6] * n for n in sizes], pa.list_(pa.int64())), pa.array([[3] * n for n in sizes], pa.list_(pa.int32())))
    return [n for p in parts for n in p.value_lengths().to_pylist()], mb


def test_prompted_chunks_of_a_large_batch_are_made_in_slices(spark, caught):
    n, mb = pooled(spark, caught, ch.Plan([ChunkConfig(2)], 1 << 30, prechunk=False, keep_tail=True, prompt="search document: "))
    assert mb < 32 and n == [-(-(k % 40) // 2) for k in range(10_000)]


def test_chunks_of_three_configurations_are_made_in_slices(spark, caught):
    n, mb = pooled(spark, caught, ch.Plan([ChunkConfig(s) for s in (1, 2, 3)], 1 << 30, prechunk=False, keep_tail=True))
    assert mb < 64 and n == [sum(-(-(k % 40) // s) for s in (1, 2, 3)) for k in range(10_000)]
