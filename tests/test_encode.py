import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.api import LateChunker, to_numpy
from chunkloom.config import ChunkConfig, Options
from chunkloom.operators import chunks as ch
from chunkloom.operators import text as tx
from chunkloom.operators.encoders import HashContextEncoder, hash_token, token_hash
from chunkloom.plans import registry
from chunkloom.streaming.encode import encode_once

DOCS = [
    (1, "Machine learning is AI. It enables learning."),
    (2, " ".join(f"This is sentence number {i}." for i in range(40))),
    (3, "Short intro. " + "with many repeated words " * 50 + ". The end."),
    (4, None), (5, ""), (6, " \n"), (7, "..."), (8, "Machine learning is AI. It enables learning."), (9, "One. ... Two."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, chunk string, embedding int")


def rows(df, *cols):
    return sorted((tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect()), key=str)


KEY = ("doc_id", "chunk_idx", "max_chunk_sents", "max_chunk_tokens", "num_sents", "first_sent", "last_sent", "is_split", "n_tokens", "chunk", "embedding")


def naive(text, size, dim=8, context=0.5):
    """Pooling by loops over one whole-document sequence."""
    sents = [[m[0].lower() for m in tx._PY_TOKEN.finditer(text[a:b])] for a, b in tx.sentence_offsets(text)]
    vec = lambda w: np.array([(hash_token(w) >> 4 * d & 15) - 7.5 for d in range(dim)])
    every = [vec(w) for s in sents for w in s]
    mean = sum(every) / len(every) if every else np.zeros(dim)
    out = []
    for i in range(0, len(sents) - min(size, len(sents)) + 1, size) if sents else []:
        own = [vec(w) for s in sents[i : i + size] for w in s]
        out.append(sum(own) / len(own) + context * mean if own else np.zeros(dim))
    return out


def test_pooling_equals_loops(docs):
    got = {}
    for r in LateChunker().encode(docs, max_length=10_000, max_chunk_sents=[1, 3]).collect():
        got.setdefault((r.doc_id, r.max_chunk_sents), []).append((r.chunk_idx, r.embedding))
    for i, t in DOCS:
        for size in (1, 3):
            want = naive(t or "", size)
            have = [e for _, e in sorted(got.get((i, size), []))]
            assert len(have) == len(want) and all(np.allclose(a, b) for a, b in zip(have, want))


@pytest.mark.parametrize("how", [{}, {"max_length": 32, "max_chunk_sents": 2}, {"max_length": 32, "max_chunk_tokens": 12, "max_chunk_sents": None}, {"max_length": 64, "max_chunk_tokens": [20, 40], "max_chunk_sents": 3, "chunk_overlap_sents": 1}, {"max_length": 32, "deduplicate": False}, {"max_length": 32, "prechunk": False}])
def test_partitions_do_not_matter(docs, how):
    one = rows(LateChunker().encode(docs.coalesce(1), **how), *KEY)
    assert one == rows(LateChunker().encode(docs.repartition(7), **how), *KEY) and one
    assert not {4, 5, 6} & {r[0] for r in one}
    assert all(how.get("max_chunk_tokens") is None or r[3] is not None for r in one)


def test_deduplication(docs):
    how = {"max_length": 32, "max_chunk_sents": 1}
    many, few = (LateChunker().encode(docs, deduplicate=d, **how) for d in (False, True))
    assert few.count() < many.count()
    assert few.select("doc_id", "first_sent", "last_sent", "chunk", "n_tokens").distinct().count() <= few.count()
    short = [F.col("doc_id") == 1]
    assert rows(many.where(short[0]), *KEY) == rows(few.where(short[0]), *KEY)
    numbers = {}
    for r in few.collect():
        numbers.setdefault(r.doc_id, []).append(r.chunk_idx)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    mean = {}
    for r in many.where("doc_id = 2").collect():
        mean.setdefault(r.first_sent, []).append(r.embedding)
    assert max(map(len, mean.values())) > 1
    for r in few.where("doc_id = 2").collect():
        assert np.allclose(r.embedding, np.mean(mean[r.first_sent], axis=0))
    with pytest.raises(ValueError, match="Invalid method"):
        LateChunker().encode(docs, deduplicate="last")


def test_text_and_no_token_lost(docs):
    text = dict(DOCS)
    got = LateChunker().encode(docs, max_length=32, max_chunk_sents=None, max_chunk_tokens=12, prechunk_overlap=0.0, count_specials=False)
    said = {}
    for r in got.orderBy("doc_id", "chunk_idx").collect():
        assert r.n_tokens <= 12 and len(tx._PY_TOKEN.findall(r.chunk)) == r.n_tokens
        said.setdefault(r.doc_id, []).extend(tx._PY_TOKEN.findall(r.chunk))
    for i, t in text.items():
        assert said.get(i, []) == tx._PY_TOKEN.findall(t or "")
    whole = {r.chunk_idx: r.chunk for r in LateChunker().encode(docs.where("doc_id = 1"), max_chunk_sents=2).collect()}
    assert whole == {0: "Machine learning is AI. It enables learning."}


def test_prompts(docs):
    plain, led = (rows(LateChunker(Options(document_prompt=p)).encode(docs, max_chunk_sents=2), *KEY) for p in (None, "Represent this document: "))
    assert [r[:-1] for r in plain] == [r[:-1] for r in led] and any(not np.allclose(a[-1], b[-1]) for a, b in zip(plain, led))
    off = rows(LateChunker(Options(document_prompt="Represent this document: ")).encode(docs, max_chunk_sents=2, prompt=""), *KEY)
    assert off == plain


def test_specials_change_first_and_last(docs):
    a, b = (rows(LateChunker().encode(docs.where("doc_id = 2"), max_length=10_000, exclude_special_tokens=x), "chunk_idx", "embedding") for x in (True, False))
    assert [x[0] for x, y in zip(sorted(a), sorted(b)) if not np.allclose(x[1], y[1])] == [0, 39]


def test_context_tells_documents_apart(spark):
    df = spark.createDataFrame([(1, "It is big. Cats purr."), (2, "It is big. Stars burn hot.")], "doc_id long, text string")
    late, flat = ({r.doc_id: r.embedding for r in LateChunker(Options(context=c)).encode(df).where("chunk_idx = 0").collect()} for c in (0.5, 0.0))
    assert late[1] != late[2] and flat[1] == flat[2]


def test_options(docs):
    d = docs.where("doc_id in (1, 2)")
    unit = LateChunker(Options(normalize=True)).encode(d)
    assert np.allclose(np.linalg.norm(to_numpy(unit), axis=1), 1)
    short = to_numpy(LateChunker(Options(truncate_dims=3)).encode(d).orderBy("doc_id", "chunk_idx"))
    assert np.allclose(short, to_numpy(LateChunker().encode(d).orderBy("doc_id", "chunk_idx"))[:, :3])
    half = to_numpy(LateChunker(Options(half=True)).encode(d))
    assert np.array_equal(half, half.astype(np.float16).astype(np.float32))
    idx = LateChunker().encode(d, index=True, return_frame="pandas")
    assert sorted(idx.idx) == list(range(len(idx))) and idx.columns[0] == "idx"
    assert "chunk" not in LateChunker().encode(d, return_text=False).columns
    assert {"sequence_idx", "tok_lo"} <= set(LateChunker().encode(d, debug=True).columns)
    assert rows(LateChunker().encode(d, debug=True), *KEY) == rows(LateChunker().encode(d), *KEY)
    for bad in ({"sent_tokenizer": "x"}, {"return_frame": "x"}, {"max_chunk_sents": 1, "chunk_overlap_sents": 1}, {"max_length": 2}, {"max_chunk_tokens": 600}):
        with pytest.raises(ValueError):
            LateChunker().encode(d, **bad)
    with pytest.raises(ValueError):
        ch.Plan([ChunkConfig(1)], 5, prompt="one two three four")


def test_tail(docs):
    d = docs.where("doc_id = 2")
    a, b = (LateChunker().encode(d, max_length=10_000, max_chunk_sents=3, keep_tail=k) for k in (False, True))
    assert (a.count(), b.count()) == (13, 14)


def test_queries_and_search(spark, docs):
    c = LateChunker(Options(query_prompt="find: "))
    q = spark.createDataFrame([(7, "Machine learning is AI."), (3, "sentence number 12"), (4, None), (5, "")], "query_id long, text string")
    plain = {r.query_id: r.embedding for r in c.encode_queries(q, prompt="").collect()}
    assert plain[4] == [0.0] * 8 == plain[5]
    led = {r.query_id: r.embedding for r in c.encode_queries(q).collect()}
    by_hand = {r.query_id: r.embedding for r in LateChunker().encode_queries(q.select("query_id", F.concat(F.lit("find: "), "text").alias("text"))).collect()}
    assert led[7] == by_hand[7] and led[7] != plain[7]
    chunks = LateChunker(Options(context=0.0)).encode(docs)
    hits = LateChunker().search(chunks, LateChunker(Options(context=0.0)).encode_queries(q), 2).collect()
    best = {(r.query_id, r.rank): (r.doc_id, r.chunk_idx, r.score) for r in hits}
    assert best[7, 1] == (1, 0, 1.0) and best[7, 2][0] == 8 and {r.query_id for r in hits} == {7, 3}


def test_token_hashes(spark):
    got = spark.createDataFrame([("ab",), ("é",)], "t string").select(token_hash(F.col("t"))).collect()
    assert [r[0] for r in got] == [hash_token("ab"), hash_token("é")]
    with pytest.raises(ValueError):
        HashContextEncoder(9)


def test_own_encoder(docs):
    class Ones:
        dim = 2

        def tokens(self, hashes):
            return np.ones((len(hashes), 2))

        def context(self, vectors):
            return None

    import pyspark.cloudpickle as cp
    import sys

    cp.register_pickle_by_value(sys.modules[__name__])
    try:
        got = LateChunker(encoder=Ones()).encode(docs.where("doc_id = 1")).collect()
    finally:
        cp.unregister_pickle_by_value(sys.modules[__name__])
    assert [r.embedding for r in got] == [[1.0, 1.0]] * 2


def test_stream_equals_batch(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    how = {"max_length": 32, "max_chunk_sents": 2}
    s = encode_once(spark, f"{tmp_path}/docs", LateChunker(), **how)
    assert rows(s, *KEY) == rows(LateChunker().encode(docs, **how), *KEY)
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs")
    with pytest.raises(ValueError, match="order"):
        LateChunker().encode(stream, index=True)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_against_sql(spark, name):
    import duckdb

    got = registry.queries()[name](spark, SMALL).toPandas()
    assert len(got)
    if name not in registry.oracle_sql():
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    clean = lambda df: sorted(str(tuple(None if x != x or x is None else x + 0 if isinstance(x, float) else x for x in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert clean(got) == clean(want)
