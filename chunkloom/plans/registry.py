"""Queries by name, and the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.api import LateChunker
from chunkloom.config import Options
from chunkloom.operators import batches as bt
from chunkloom.operators import chunks as ch
from chunkloom.operators import text as tx
from chunkloom.operators import vectors as vx
from chunkloom.operators.order import numbered
from chunkloom.plans import sql as q
from chunkloom.sources.tables import spread
from chunkloom.streaming.encode import encode_once

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIMS = [f"e{d}" for d in range(q.D)]
PROMPT = "search document: "
QUERY_PROMPT = "search query: "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, counts): tokens a sentence."""
    return docs(spark, sf_dir).select("doc_id", F.transform(tx.sentence_texts(F.col("text")), lambda s: F.size(tx.words(s))).alias("counts"))


def rounded(x: Column, digits: int) -> Column:
    """As ``sql.rounded``."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _dims(df: DataFrame, *keys: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    return df.select(*keys, *(rounded(F.get(vector, F.lit(d)), digits).alias(e) for d, e in enumerate(DIMS)))


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes)


# --- sentences and tokens


@query(_with(q.SENTS) + " SELECT doc_id, CAST(sent_id AS INT) AS sent_id, sent AS sentence FROM sents")
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentence_texts(F.col("text"))).alias("sent_id", "sentence"))


@query(rf"""
    WITH parts AS (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{q.SENTENCE}|{q.GAP}') AS l FROM documents)),
    placed AS (SELECT doc_id, p, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM parts)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS sent_id, CAST(e - length(p) AS INT) AS start_at, CAST(e AS INT) AS end_at
    FROM placed WHERE NOT regexp_matches(p, '^{q.GAP}')""")
def sentence_offsets(spark, sf_dir):
    return tx.sentences(docs(spark, sf_dir)).select("doc_id", "sent_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(_with(q.SENTS) + " SELECT d.lang, count(*) AS n_sents, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(sent)) AS BIGINT) AS n_chars FROM sents JOIN documents d USING (doc_id) GROUP BY d.lang")
def sentence_stats_by_lang(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(tx.sentence_texts(F.col("text"))).alias("s"))
    return s.groupBy("lang").agg(F.count("*").alias("n_sents"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("s")).alias("n_chars"))


@query(r"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)")
def tokenize_counts(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


_PLACED = r"""placed AS (
    SELECT doc_id, p, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS l FROM documents))),
    toks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS tok_id, lower(p) AS token, CAST(e - length(p) AS INT) AS start_at, CAST(e AS INT) AS end_at
             FROM placed WHERE regexp_matches(p, '^[\p{L}\p{N}]'))"""


@query(f"WITH {_PLACED} SELECT * FROM toks")
def token_offsets(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.posexplode(tx.locate_tokens(F.col("text"))).alias("tok_id", "t"))
    return t.select("doc_id", "tok_id", "t.token", F.col("t.start").alias("start_at"), F.col("t.end").alias("end_at"))


@query(f"""WITH {_PLACED}, s AS ({_SQL['sentence_offsets']})
    SELECT t.doc_id, t.tok_id, s.sent_id FROM toks t LEFT JOIN s ON s.doc_id = t.doc_id AND t.start_at >= s.start_at AND t.end_at <= s.end_at""")
def token_sentence_map(spark, sf_dir):
    return tx.tokens(docs(spark, sf_dir)).select("doc_id", "tok_id", "sent_id")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 32), 96)) AS s FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(s // 96 AS INT) AS seq_no, len(list_slice(w, s + 1, s + 128)) AS n_tokens, md5(array_to_string(list_slice(w, s + 1, s + 128), ' ')) AS digest FROM s""")
def overflow_windows(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", F.posexplode(tx.overflow_windows(tx.words(F.col("text")), 128, 32)).alias("seq_no", "w"))
    return w.select("doc_id", "seq_no", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1, 126) AS w FROM documents)")
def truncate_tokens(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", tx.truncated(tx.words(F.col("text")), 128).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


# --- sequences


@query(_with(q.SENTS, q.WORDS, q.COUNTS) + """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, p) - 1 AS INT) AS unit_id, CAST(sent_id AS INT) AS sent_id, CAST(p AS INT) AS sub, CAST(least(16, n - p * 16) AS INT) AS n_tokens
    FROM (SELECT doc_id, sent_id, n, unnest(range(greatest(1, CAST(ceil(n / 16.0) AS BIGINT)))) AS p FROM counts)""")
def split_long_sents(spark, sf_dir):
    u = _counts(spark, sf_dir).select("doc_id", F.posexplode(ch.long_units(F.col("counts"), 16)).alias("unit_id", "u"))
    return u.select("doc_id", "unit_id", F.col("u.sent").alias("sent_id"), "u.sub", F.col("u.n").alias("n_tokens"))


_SEQ = "SELECT doc_id, seq_no, CAST(first_sent AS INT) AS first_sent, CAST(first_sub AS INT) AS first_sub, CAST(last_sent AS INT) AS last_sent, CAST(last_sub AS INT) AS last_sub, CAST(n_tokens AS INT) AS n_tokens FROM runs"


def _sequences(spark, sf_dir, room, overlap):
    s = _counts(spark, sf_dir).select("doc_id", F.explode(ch.packed_sequences(F.col("counts"), room, overlap)).alias("s"))
    return s.select("doc_id", "s.*")


@query(_with(q.SENTS, q.WORDS, q.COUNTS, q.sequences(126), recursive=True) + " " + _SEQ)
def prechunk_sequences(spark, sf_dir):
    return _sequences(spark, sf_dir, 126, 0.5)


@query(_with(q.SENTS, q.WORDS, q.COUNTS, q.sequences(126, 0, 1), recursive=True) + " " + _SEQ)
def prechunk_no_overlap(spark, sf_dir):
    return _sequences(spark, sf_dir, 126, 0.0)


# --- chunk windows


def _windows(spark, sf_dir, size, overlap=0):
    n = docs(spark, sf_dir).select("doc_id", F.size(tx.sentence_texts(F.col("text"))).alias("n"))
    return n.select("doc_id", F.posexplode(ch.windows(F.col("n"), size, overlap)).alias("chunk_idx", "w")).select("doc_id", "chunk_idx", F.col("w.first").alias("first_sent"), F.col("w.last").alias("last_sent"))


def _windows_sql(size: int, overlap: int = 0) -> str:
    return _with(q.SENTS, q.WORDS, q.COUNTS) + f" SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_sent) - 1 AS INT) AS chunk_idx, first_sent, last_sent FROM ({q.windows(size, overlap)})"


@query(_windows_sql(1))
def sent_windows_1(spark, sf_dir):
    return _windows(spark, sf_dir, 1)


@query(_windows_sql(2, 1))
def sent_windows_2_overlap1(spark, sf_dir):
    return _windows(spark, sf_dir, 2, 1)


_MULTI = [(1, 0), (3, 1), (5, 2)]


@query(_with(q.SENTS, q.WORDS, q.COUNTS) + " " + " UNION ALL ".join(f"SELECT {s} AS size, doc_id, first_sent, last_sent FROM ({q.windows(s, o)})" for s, o in _MULTI))
def sent_windows_multi(spark, sf_dir):
    def sized(size, overlap):
        return F.transform(ch.windows(F.col("n"), size, overlap), lambda w: F.struct(F.lit(size).alias("size"), w["first"].alias("first_sent"), w["last"].alias("last_sent")))

    n = docs(spark, sf_dir).select("doc_id", F.size(tx.sentence_texts(F.col("text"))).alias("n"))
    every = F.flatten(F.array(*(sized(s, o) for s, o in _MULTI)))
    return n.select("doc_id", F.explode(every).alias("w")).select("doc_id", "w.*")


_CHUNKS = "SELECT doc_id, CAST(chunk_no AS INT) AS chunk_idx, CAST(first_sent AS INT) AS first_sent, CAST(last_sent AS INT) AS last_sent, is_split, CAST(n_tokens AS INT) AS n_tokens FROM chunks"


def _greedy(spark, sf_dir, *args, **how):
    c = _counts(spark, sf_dir).select("doc_id", F.posexplode(ch.greedy_chunks(F.col("counts"), *args, **how)).alias("chunk_idx", "c"))
    return c.select("doc_id", "chunk_idx", F.col("c.first").alias("first_sent"), F.col("c.last").alias("last_sent"), (F.col("c.piece") >= 0).alias("is_split"), "c.n_tokens")


def _greedy_sql(*args, **how) -> str:
    return _with(q.SENTS, q.WORDS, q.COUNTS, q.greedy(*args, **how), recursive=True) + " " + _CHUNKS


@query(_greedy_sql(40, split=False))
def token_chunks(spark, sf_dir):
    return _greedy(spark, sf_dir, 40, split=False)


@query(_greedy_sql(64, sents=3))
def token_chunks_sents(spark, sf_dir):
    return _greedy(spark, sf_dir, 64, sents=3)


@query(_greedy_sql(40, overlap=1))
def token_chunks_overlap(spark, sf_dir):
    return _greedy(spark, sf_dir, 40, overlap=1)


@query(_greedy_sql(16))
def token_chunks_split(spark, sf_dir):
    return _greedy(spark, sf_dir, 16)


@query(_greedy_sql(16, split=False, overlap=1))
def token_chunks_keep(spark, sf_dir):
    return _greedy(spark, sf_dir, 16, split=False, overlap=1)


@query(_with(q.SENTS, q.WORDS, q.COUNTS) + """
    SELECT doc_id, chunk_idx, first_sent, last_sent, (SELECT string_agg(s.sent, ' ' ORDER BY s.sent_id) FROM sents s WHERE s.doc_id = w.doc_id AND s.sent_id BETWEEN w.first_sent AND w.last_sent) AS chunk
    FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_sent) - 1 AS INT) AS chunk_idx, first_sent, last_sent FROM (""" + q.windows(3, 1) + ")) w")
def chunk_text(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", tx.sentence_texts(F.col("text")).alias("sents"))
    w = s.select("doc_id", "sents", F.posexplode(ch.windows(F.size("sents"), 3, 1)).alias("chunk_idx", "w"))
    return w.select("doc_id", "chunk_idx", F.col("w.first").alias("first_sent"), F.col("w.last").alias("last_sent"), F.array_join(F.slice("sents", F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1), " ").alias("chunk"))


# --- embedding


def _encode(spark, sf_dir, options=None, **how):
    how = {"prechunk": False, "max_length": 1 << 30, "return_text": False, "keep_tail": True} | how
    return LateChunker(options).encode(docs(spark, sf_dir), **how)


def _pooled_sql(size: int, overlap: int = 0, context: float = 0.5, extra: str = "") -> str:
    win = f"win AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_sent) - 1 AS INT) AS chunk_idx, first_sent, last_sent FROM ({q.windows(size, overlap, True)}))"
    return _with(q.BASE, win, q.pooled("win", context)) + f" SELECT doc_id, chunk_idx, CAST(n_tokens AS INT) AS n_tokens, {', '.join(DIMS)} FROM pool"


@query(_pooled_sql(2, 1))
def pool_mean(spark, sf_dir):
    return _dims(_encode(spark, sf_dir, max_chunk_sents=2, chunk_overlap_sents=1), "doc_id", "chunk_idx", "n_tokens")


@query(_pooled_sql(3, 0, 0.0))
def pool_without_context(spark, sf_dir):
    return _dims(_encode(spark, sf_dir, Options(context=0.0), max_chunk_sents=3), "doc_id", "chunk_idx", "n_tokens")


_SPECIAL = {c: f"(((CAST('0x' || substr(md5('{c}'), 1, 8) AS BIGINT) >> {{s}}) & 15) - 7.5)" for c in (ch.CLS, ch.SEP)}


@query(
    _with(q.BASE, f"win AS ({q.windows(2, 0, True)})", "flag AS (SELECT *, first_sent = 0 AS a, last_sent = max(last_sent) OVER (PARTITION BY doc_id) AS b FROM win)", f"docsum AS (SELECT doc_id, sum(n) AS dn, {', '.join(f'sum(v{d}) AS c{d}' for d in range(q.D))} FROM sums GROUP BY doc_id)")
    + f"""
    SELECT f.doc_id, f.first_sent, f.last_sent, {", ".join(q.rounded(f"CASE WHEN sum(s.n) + any_value(a::INT + b::INT) = 0 THEN 0 ELSE (sum(s.v{d}) + any_value(a::INT * {_SPECIAL[ch.CLS].format(s=4 * d)} + b::INT * {_SPECIAL[ch.SEP].format(s=4 * d)})) / (sum(s.n) + any_value(a::INT + b::INT)) + 0.5 * coalesce(any_value(c{d} / nullif(dn, 0)), 0) END", 6) + f" AS e{d}" for d in range(q.D))}
    FROM flag f JOIN sums s ON s.doc_id = f.doc_id AND s.sent_id BETWEEN f.first_sent AND f.last_sent JOIN docsum ON docsum.doc_id = f.doc_id GROUP BY f.doc_id, f.first_sent, f.last_sent"""
)
def pool_boundary_specials(spark, sf_dir):
    return _dims(_encode(spark, sf_dir, max_chunk_sents=2, exclude_special_tokens=False), "doc_id", "first_sent", "last_sent")


_LATE = [(1, None), (2, None), (3, None)]


@query(
    _with(q.BASE, "win AS (" + " UNION ALL ".join(f"SELECT {s} AS max_chunk_sents, * FROM ({q.windows(s, 0, True)})" for s, _ in _LATE) + ")", q.pooled("win"))
    + f" SELECT doc_id, max_chunk_sents, first_sent, last_sent, CAST(last_sent - first_sent + 1 AS INT) AS num_sents, {', '.join(DIMS)} FROM pool"
)
def aligned_configs(spark, sf_dir):
    return _dims(_encode(spark, sf_dir, max_chunk_sents=[s for s, _ in _LATE]), "doc_id", "max_chunk_sents", "first_sent", "last_sent", "num_sents")


@query(
    _with(q.BASE, f"win AS ({q.windows(1)})", q.pooled("win"))
    + f", plain AS (SELECT doc_id, sent_id, {', '.join(f'CASE WHEN n = 0 THEN 0 ELSE v{d} / n END AS p{d}' for d in range(q.D))} FROM sums)"
    + f" SELECT doc_id, count(*) AS n_chunks, CAST(sum({' + '.join(f"CAST(round(abs(e{d} - {q.rounded(f'p{d}', 6)}) * 1e6) AS BIGINT)" for d in range(q.D))}) AS BIGINT) AS shift_millionths FROM pool JOIN plain USING (doc_id) WHERE plain.sent_id = pool.first_sent GROUP BY doc_id"
)
def late_vs_naive(spark, sf_dir):
    """How far context moves the chunks of each document, added up in whole millionths, so that the order of rows doesn't matter."""
    late = _dims(_encode(spark, sf_dir), "doc_id", "chunk_idx")
    plain = _dims(_encode(spark, sf_dir, Options(context=0.0)), "doc_id", "chunk_idx")
    both = late.alias("a").join(plain.alias("b"), ["doc_id", "chunk_idx"])
    shift = sum((F.round(F.abs(F.col(f"a.{e}") - F.col(f"b.{e}")) * 1e6).cast("bigint") for e in DIMS), F.lit(0))
    return both.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(shift).alias("shift_millionths"))


_DEDUP = f"""
    span AS (SELECT r.doc_id, r.seq_no, u.u, u.sent_id, u.sub, u.n, least(u.n, 126) AS m FROM runs r JOIN units u ON u.doc_id = r.doc_id AND u.u BETWEEN r.first AND r.last),
    utok AS (SELECT t.*, (t.at // 126) AS sub FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 AS at FROM (
        SELECT doc_id, sent_id, {', '.join(f'(((h >> {4 * d}) & 15) - 7.5) AS x{d}' for d in range(q.D))}, pos FROM (
            SELECT doc_id, sent_id, pos, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, sent_id, unnest(w) AS tok, unnest(range(len(w))) AS pos FROM words)))) t),
    usum AS (SELECT doc_id, sent_id, sub, {', '.join(f'sum(x{d}) AS v{d}' for d in range(q.D))} FROM utok GROUP BY ALL),
    full_span AS (SELECT s.*, {', '.join(f'coalesce(z.v{d}, 0) AS v{d}' for d in range(q.D))} FROM span s LEFT JOIN usum z USING (doc_id, sent_id, sub)),
    ctx AS (SELECT doc_id, seq_no, sum(n) AS sn, {', '.join(f'sum(v{d}) AS c{d}' for d in range(q.D))} FROM full_span GROUP BY ALL),
    per AS (SELECT s.doc_id, s.seq_no, s.sent_id, s.sub, s.n, {', '.join(f'CASE WHEN s.n = 0 THEN 0 ELSE v{d} / s.n + 0.5 * (c{d} / sn) END AS e{d}' for d in range(q.D))} FROM full_span s JOIN ctx USING (doc_id, seq_no)),
    ded AS (SELECT doc_id, sent_id, sub, min(seq_no) AS seq_no, any_value(n) AS n, {{agg}} FROM per GROUP BY doc_id, sent_id, sub)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, sub) - 1 AS INT) AS chunk_idx, CAST(sent_id AS INT) AS first_sent, CAST(n AS INT) AS n_tokens, {{out}} FROM ded"""


def _dedup_sql(how: str) -> str:
    agg = ", ".join(f"avg(e{d}) AS e{d}" if how == "average" else f"min_by(e{d}, seq_no) AS e{d}" for d in range(q.D))
    return _with(q.SENTS, q.WORDS, q.COUNTS, q.sequences(126), recursive=True) + "," + _DEDUP.format(agg=agg, out=", ".join(q.rounded(f"e{d}", 5) + f" AS e{d}" for d in range(q.D)))


def _dedup(spark, sf_dir, how):
    c = LateChunker().encode(docs(spark, sf_dir), max_length=128, deduplicate=how, return_text=False)
    return _dims(c, "doc_id", "chunk_idx", "first_sent", "n_tokens", digits=5)


@query(_dedup_sql("average"))
def dedup_average(spark, sf_dir):
    return _dedup(spark, sf_dir, "average")


@query(_dedup_sql("first"))
def dedup_first(spark, sf_dir):
    return _dedup(spark, sf_dir, "first")


@query(_with(q.SENTS, q.WORDS, q.COUNTS, f"win AS ({q.windows(2)})") + " SELECT CAST(row_number() OVER (ORDER BY doc_id, first_sent) - 1 AS BIGINT) AS idx, doc_id, first_sent FROM win")
def chunk_reindex(spark, sf_dir):
    """A global row number without a single-partition window: places within the partitions of a range sort, then offsets."""
    return numbered(_windows(spark, sf_dir, 2).select("doc_id", "first_sent"), ["doc_id", "first_sent"])


_IDX = " UNION ALL ".join(f"SELECT {s} AS max_chunk_sents, * FROM ({q.windows(s, 0, True)})" for s in (1, 3))


@query(
    _with(q.BASE, f"win AS (SELECT doc_id, max_chunk_sents, first_sent, last_sent FROM ({_IDX}))", q.pooled("win"))
    + f""" SELECT CAST(row_number() OVER (ORDER BY doc_id, max_chunk_sents, first_sent) - 1 AS BIGINT) AS idx, doc_id, max_chunk_sents, CAST(row_number() OVER (PARTITION BY doc_id, max_chunk_sents ORDER BY first_sent) - 1 AS INT) AS chunk_idx,
    (SELECT md5(string_agg(s.sent, ' ' ORDER BY s.sent_id)) FROM sents s WHERE s.doc_id = p.doc_id AND s.sent_id BETWEEN p.first_sent AND p.last_sent) AS digest, {', '.join(DIMS)} FROM pool p"""
)
def encode_indexed(spark, sf_dir):
    """Whole chunk rows, texts and vectors included, with their number among all chunks."""
    c = _encode(spark, sf_dir, max_chunk_sents=[1, 3], return_text=True, index=True)
    return _dims(c.withColumn("digest", F.md5("chunk")), "idx", "doc_id", "max_chunk_sents", "chunk_idx", "digest")


# --- vector functions


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _long(df: DataFrame, col, digits: int | None = 6) -> DataFrame:
    out = df.select("vec_id", F.posexplode(col).alias("dim", "x"))
    return out.select("vec_id", "dim", (F.round("x", digits) if digits else F.col("x")).alias("value"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, unnest(e) AS x, CAST(unnest(range(len(e))) AS INT) AS dim, sqrt(list_dot_product(e, e)) AS n FROM v)"
_HALF = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(f"WITH {_VEC} SELECT vec_id, dim, round(x / greatest(n, 1e-12), 6) AS value FROM x")
def vec_normalize(spark, sf_dir):
    return _long(_vectors(spark, sf_dir), vx.normalized(F.col("v")))


@query(f"WITH {_VEC} SELECT vec_id, dim, round(x, 6) AS value FROM x WHERE dim < 16")
def vec_truncate(spark, sf_dir):
    return _long(_vectors(spark, sf_dir), vx.truncated(F.col("v"), 16))


@query(f"WITH {_VEC} SELECT vec_id, dim, {_HALF} AS value FROM x")
def vec_half(spark, sf_dir):
    return _long(_vectors(spark, sf_dir), vx.halved(F.col("v")), None)


@query(f"WITH {_VEC}, h AS (SELECT vec_id, dim, {_HALF} AS x FROM x), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM h GROUP BY vec_id) SELECT vec_id, dim, round(x / greatest(n, 1e-12), 6) AS value FROM h JOIN n USING (vec_id)")
def vec_postprocess(spark, sf_dir):
    return _long(_vectors(spark, sf_dir), vx.postprocessed(F.col("v"), Options(normalize=True, half=True)))


@query(f"WITH {_VEC} SELECT label, dim, round(avg(x), 6) AS value FROM x JOIN embeddings USING (vec_id) GROUP BY label, dim")
def vec_group_mean(spark, sf_dir):
    m = vx.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", "dim", F.round("value", 6).alias("value"))


# --- retrieval


_Q = q.query_vectors("benchmark", "item_id")
_CHUNK1 = _with(q.BASE, f"win AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_sent) - 1 AS INT) AS chunk_idx, first_sent, last_sent FROM ({q.windows(3, 0, True)}))", q.pooled("win"), _Q)
_DOT = " + ".join(f"p.e{d} * q.e{d}" for d in range(q.D))
_LEN = {t: "sqrt(" + " + ".join(f"{t}.e{d} * {t}.e{d}" for d in range(q.D)) + ")" for t in "pq"}


def _queries(spark, sf_dir, **how):
    return LateChunker().encode_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), **how)


def _chunks3(spark, sf_dir):
    c = _encode(spark, sf_dir, max_chunk_sents=3)
    return c.withColumn("embedding", F.transform("embedding", lambda x: rounded(x, 6)))


def _rank(score: str, k: int) -> str:
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, doc_id, chunk_idx, score FROM (
        SELECT q.id AS query_id, p.doc_id, p.chunk_idx, {score} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {score} DESC, p.doc_id, p.chunk_idx) AS rank FROM pool p, qvec q WHERE {_LEN['p']} > 0 AND {_LEN['q']} > 0) WHERE rank <= {k}"""


@query(_CHUNK1 + " " + _rank(q.rounded(_DOT, 4), 5))
def dot_scores(spark, sf_dir):
    c = _chunks3(spark, sf_dir).where(vx.norm(F.col("embedding")) > 0)
    return vx.top_k(c.select("doc_id", "chunk_idx", "embedding"), _queries(spark, sf_dir), 5, "dot", digits=4)


@query(_CHUNK1 + " " + _rank(q.rounded(f"({_DOT}) / ({_LEN['p']} * {_LEN['q']})", 5), 10))
def contextual_search(spark, sf_dir):
    """The flagship: documents chunked, embedded in context, and searched for every test item."""
    c = _chunks3(spark, sf_dir)
    return vx.top_k(c.select("doc_id", "chunk_idx", "embedding"), _queries(spark, sf_dir), 10, "cosine", digits=5)


_COS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


_COS_SCORE = q.rounded("list_cosine_similarity(a.e, b.e)", 5)


@query(_COS + f""" SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
    SELECT a.vec_id AS query_id, b.vec_id, {_COS_SCORE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS_SCORE} DESC, b.vec_id) AS rank FROM v a, v b) WHERE rank <= 4""")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vx.top_k(v.select("vec_id", "embedding"), v.select(F.col("vec_id").alias("query_id"), "embedding"), 4, "cosine", digits=5)


_SIM = f"sim AS (SELECT q.id AS query_id, p.doc_id, avg(({_DOT}) / ({_LEN['p']} * {_LEN['q']})) AS s FROM pool p, qvec q WHERE {_LEN['p']} > 0 AND {_LEN['q']} > 0 GROUP BY ALL)"


def _doc_means(spark, sf_dir) -> DataFrame:
    """(doc_id, embedding): the mean of a document's unit chunk vectors.  Its product with a unit query is the average cosine of
    the document's chunks to the query, so chunks are reduced to one vector a document before queries come in."""
    unit = _chunks3(spark, sf_dir).where(vx.norm(F.col("embedding")) > 0).select("doc_id", vx.normalized(F.col("embedding")).alias("u"))
    return unit.groupBy("doc_id").agg(F.array(*(F.avg(F.get("u", F.lit(d))) for d in range(q.D))).alias("embedding"))


def _unit_queries(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).where(vx.norm(F.col("embedding")) > 0).select("query_id", vx.normalized(F.col("embedding")).alias("embedding"))


@query(_CHUNK1 + f", {_SIM} SELECT query_id, doc_id, {q.rounded('s', 5)} + 0.0::DOUBLE AS similarity FROM sim")
def doc_avg_similarity(spark, sf_dir):
    """A report of all documents for all queries."""
    means = _doc_means(spark, sf_dir)
    found = vx.top_k(means, _unit_queries(spark, sf_dir), None, "dot", digits=5)
    return found.select("query_id", "doc_id", (F.col("score") + 0.0).alias("similarity"))


@query(_CHUNK1 + f", {_SIM} SELECT query_id, min_by(doc_id, (-{q.rounded('s', 5)}, doc_id)) AS doc_id, max({q.rounded('s', 5)}) + 0.0::DOUBLE AS similarity FROM sim GROUP BY query_id")
def best_doc(spark, sf_dir):
    return vx.top_k(_doc_means(spark, sf_dir), _unit_queries(spark, sf_dir), 1, "dot", digits=5).select("query_id", "doc_id", (F.col("score") + 0.0).alias("similarity"))


def _qsql(prompt: str, table: str, key: str, where: str = "true") -> str:
    return "WITH " + q.query_vectors(table, key, prompt, where) + f" SELECT id AS query_id, {', '.join(q.rounded(f'e{d}', 6) + f' AS e{d}' for d in range(q.D))} FROM qvec"


@query(_qsql("", "benchmark", "item_id"))
def query_embed(spark, sf_dir):
    return _dims(_queries(spark, sf_dir), "query_id")


@query(_qsql(QUERY_PROMPT, "(SELECT conv_id * 1000 + turn AS k, * FROM conversations)", "k", "role = 'user'"))
def query_prompt_embed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return _dims(LateChunker(Options(query_prompt=QUERY_PROMPT)).encode_queries(c), "query_id")


_PROMPT_SUM = {d: " + ".join(f"(((CAST('0x' || substr(md5('{w}'), 1, 8) AS BIGINT) >> {4 * d}) & 15) - 7.5)" for w in PROMPT.replace(":", "").split()) for d in range(q.D)}


@query(
    _with(q.BASE, f"win AS ({q.windows(2, 0, True)})", f"docsum AS (SELECT doc_id, sum(n) + {len(PROMPT.split())} AS dn, {', '.join(f'sum(v{d}) + {_PROMPT_SUM[d]} AS c{d}' for d in range(q.D))} FROM sums GROUP BY doc_id)")
    + f""" SELECT w.doc_id, w.first_sent, w.last_sent, {', '.join(q.rounded(f"CASE WHEN sum(s.n) = 0 THEN 0 ELSE sum(s.v{d}) / sum(s.n) + 0.5 * (any_value(c{d}) / any_value(dn)) END", 6) + f" AS e{d}" for d in range(q.D))}
    FROM win w JOIN sums s ON s.doc_id = w.doc_id AND s.sent_id BETWEEN w.first_sent AND w.last_sent JOIN docsum ON docsum.doc_id = w.doc_id GROUP BY w.doc_id, w.first_sent, w.last_sent"""
)
def document_prompt_embed(spark, sf_dir):
    return _dims(_encode(spark, sf_dir, max_chunk_sents=2, prompt=PROMPT), "doc_id", "first_sent", "last_sent")


# --- batching and reports


_POW2 = "CASE WHEN {x} <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2({x}))) AS BIGINT) END"


@query(
    rf"""WITH RECURSIVE n AS (SELECT doc_id % 8 AS task, doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS n_tokens FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n_tokens DESC, doc_id) AS i FROM n),
    step AS (
        SELECT task, i, CAST(0 AS BIGINT) AS batch_no, CAST(1 AS BIGINT) AS held, {_POW2.format(x="n_tokens")} AS width FROM r WHERE i = 1
        UNION ALL
        SELECT s.task, r.i, CASE WHEN (s.held + 1) * s.width <= 16384 THEN s.batch_no ELSE s.batch_no + 1 END, CASE WHEN (s.held + 1) * s.width <= 16384 THEN s.held + 1 ELSE 1 END,
               CASE WHEN (s.held + 1) * s.width <= 16384 THEN s.width ELSE {_POW2.format(x="r.n_tokens")} END
        FROM step s JOIN r ON r.task = s.task AND r.i = s.i + 1)
    SELECT r.task, r.doc_id, r.n_tokens, s.batch_no, count(*) OVER (PARTITION BY r.task, s.batch_no) AS batch_rows, s.width FROM step s JOIN r USING (task, i)"""
)
def batch_plan(spark, sf_dir):
    """The batches that ``encode`` makes, for eight tasks."""
    n = docs(spark, sf_dir).select((F.col("doc_id") % 8).alias("task"), "doc_id", F.size(tx.words(F.coalesce("text", F.lit("")))).alias("n_tokens"))
    return bt.batch_plan(n, "doc_id", "n_tokens", 16384, "task")


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM documents)
    SELECT doc_id, n AS n_tokens, CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(n))) AS BIGINT) END AS padded, CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(n))) AS BIGINT) END - n AS n_pad FROM n""")
def pad_arrays(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    full = w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), bt.padded(F.col("w"), F.lit("[PAD]"), bt.power_of_two(F.size("w"))).alias("p"))
    return full.select("doc_id", "n_tokens", F.size("p").cast("bigint").alias("padded"), F.size(F.filter("p", lambda x: x == "[PAD]")).cast("bigint").alias("n_pad"))


@query("""WITH r AS (SELECT coalesce(CAST(label AS VARCHAR), CASE WHEN grouping(label) = 1 THEN '_total_' END) AS label, count(*) AS n_vectors, CAST(sum(len(embedding) * 4) AS BIGINT) AS n_bytes FROM embeddings GROUP BY ROLLUP(label))
    SELECT label, n_vectors, n_bytes, CASE WHEN n_bytes < 1024 THEN printf('%.2f B', n_bytes * 1.0::DOUBLE) WHEN n_bytes < 1048576 THEN printf('%.2f KB', n_bytes / 1024.0::DOUBLE) ELSE printf('%.2f MB', n_bytes / 1048576.0::DOUBLE) END AS size FROM r""")
def memory_report(spark, sf_dir):
    return vx.memory_report(table(spark, sf_dir, "embeddings"), "label")


@query(_pooled_sql(2, 1))
def encode_stream_windows(spark, sf_dir):
    """``pool_mean``, by Structured Streaming."""
    how = {"prechunk": False, "max_length": 1 << 30, "return_text": False, "keep_tail": True, "max_chunk_sents": 2, "chunk_overlap_sents": 1}
    return _dims(encode_once(spark, f"{sf_dir}/documents.parquet", LateChunker(), **how), "doc_id", "chunk_idx", "n_tokens")


@query()
def encode_stream(spark, sf_dir):
    """The same chunks, made by Structured Streaming from the documents' files."""
    return encode_once(spark, f"{sf_dir}/documents.parquet", LateChunker(), max_chunk_tokens=64, max_chunk_sents=4).select("doc_id", "chunk_idx", "num_sents", "is_split", "n_tokens", "chunk", *(F.round(F.get("embedding", F.lit(d)), 6).alias(e) for d, e in enumerate(DIMS)))


