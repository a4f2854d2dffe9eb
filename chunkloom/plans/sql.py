"""SQL that states what the queries return, in DuckDB's dialect."""

from __future__ import annotations

D = 8


def rounded(x: str, digits: int) -> str:
    """Rounded the same way by any engine with IEEE arithmetic; the engines' own ``round`` differ next to ties."""
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


#: Sentences begin and end with what isn't blank; see ``operators.text.SENTENCE``.
SENTENCE = r"[^.!?\n \t\r\f\x0B](?:[^.!?\n]*[.!?]+|[^.!?\n]*[^.!?\n \t\r\f\x0B]|)"
GAP = r"[.!?\n \t\r\f\x0B]+"
SENTS = f"""sents AS (
    SELECT doc_id, unnest(l) AS sent, unnest(range(len(l))) AS sent_id
    FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS l FROM documents WHERE text IS NOT NULL))"""
WORDS = """words AS (
    SELECT doc_id, sent_id, sent, regexp_extract_all(lower(sent), '[\\p{L}\\p{N}]+') AS w FROM sents)"""
COUNTS = "counts AS (SELECT doc_id, sent_id, sent, len(w) AS n FROM words)"
_NIBBLES = ", ".join(f"(((h >> {4 * d}) & 15) - 7.5) AS x{d}" for d in range(D))
TOKENS = f"""toks AS (
    SELECT doc_id, sent_id, tok, {_NIBBLES}
    FROM (SELECT doc_id, sent_id, tok, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, sent_id, unnest(w) AS tok FROM words)))"""
SUMS = f"""sums AS (
    SELECT c.doc_id, c.sent_id, c.n, {", ".join(f"coalesce(s.v{d}, 0) AS v{d}" for d in range(D))}
    FROM counts c LEFT JOIN (SELECT doc_id, sent_id, {", ".join(f"sum(x{d}) AS v{d}" for d in range(D))} FROM toks GROUP BY ALL) s USING (doc_id, sent_id))"""
BASE = f"{SENTS}, {WORDS}, {COUNTS}, {TOKENS}, {SUMS}"
_E = ", ".join(f"e{d}" for d in range(D))


def windows(size: int, overlap: int = 0, tail: bool = False) -> str:
    """(doc_id, first_sent, last_sent) of sliding windows over ``counts``; with a tail, the last one may be shorter."""
    end = f"greatest(1, n - {overlap})" if tail else f"n - least({size}, n) + 1"
    return f"""
        SELECT doc_id, CAST(s AS INT) AS first_sent, CAST(least(s + {size}, n) - 1 AS INT) AS last_sent
        FROM (SELECT doc_id, n, unnest(range(0, {end}, {size - overlap})) AS s FROM (SELECT doc_id, count(*) AS n FROM counts GROUP BY doc_id))"""


def greedy(most: int, sents: int | None = None, overlap: int = 0, split: bool = True) -> str:
    """Recursive CTE ``fold`` and ``chunks(doc_id, chunk_no, first_sent, last_sent, is_split, n_tokens)``; overlap 0 or 1.

    The state is the open chunk (its number, first sentence, sentences, tokens) and the number of the next.
    """
    assert overlap in (0, 1)
    fits = f"f.tok + c.n <= {most}" + (f" AND f.held < {sents}" if sents else "")
    cut = f"c.n > {most} AND {str(split).lower()}"
    pieces = f"CAST(ceil(c.n / {most}.0) AS BIGINT)"
    over = f"(f.held > 0 AND {overlap} = 1 AND c.n <= {most})"
    return f"""
    fold AS (
        SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS tok, CAST(0 AS BIGINT) AS prev, CAST(0 AS BIGINT) AS cuts
        FROM (SELECT DISTINCT doc_id FROM counts)
        UNION ALL
        SELECT f.doc_id, f.i + 1,
            CASE WHEN {fits} THEN f.no ELSE f.no + (f.held > 0)::INT + CASE WHEN {cut} THEN {pieces} ELSE 0 END END,
            CASE WHEN {fits} THEN CASE WHEN f.held = 0 THEN c.sent_id ELSE f.first END WHEN {over} THEN c.sent_id - 1 ELSE c.sent_id END,
            CASE WHEN {fits} THEN f.held + 1 WHEN {cut} THEN 0 WHEN {over} THEN 2 ELSE 1 END,
            CASE WHEN {fits} THEN f.tok + c.n WHEN {cut} THEN 0 WHEN {over} THEN f.prev + c.n ELSE c.n END,
            c.n,
            CASE WHEN NOT ({fits}) AND {cut} THEN {pieces} ELSE 0 END
        FROM fold f JOIN counts c ON c.doc_id = f.doc_id AND c.sent_id = f.i + 1),
    whole AS (
        SELECT doc_id, no, max_by(first, i) AS first_sent, max(i) AS last_sent, max_by(tok, i) AS n_tokens
        FROM fold WHERE i >= 0 AND held > 0 GROUP BY doc_id, no),
    pieces AS (
        SELECT doc_id, no - cuts + p AS no, i AS first_sent, i AS last_sent, least({most}, prev - p * {most}) AS n_tokens
        FROM (SELECT *, unnest(range(cuts)) AS p FROM fold WHERE cuts > 0)),
    chunks AS (
        SELECT doc_id, no AS chunk_no, first_sent, last_sent, false AS is_split, n_tokens FROM whole
        UNION ALL SELECT doc_id, no, first_sent, last_sent, true, n_tokens FROM pieces)"""


def sequences(room: int, numerator: int = 1, denominator: int = 2) -> str:
    """Recursive CTE ``runs(doc_id, seq_no, first, last, n_tokens)`` of unit positions, over ``units`` with running totals.

    The next run starts at i less floor(had * overlap), or later if the units kept leave no room.
    """
    return f"""
    units AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, sub) - 1 AS u, sent_id, sub, n,
               sum(n) OVER (PARTITION BY doc_id ORDER BY sent_id, sub) AS upto
        FROM (SELECT doc_id, sent_id, p AS sub, least({room}, n - p * {room}) AS n
              FROM (SELECT doc_id, sent_id, n, unnest(range(greatest(1, CAST(ceil(n / {room}.0) AS BIGINT)))) AS p FROM counts))),
    step AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS done FROM units WHERE u = 0
        UNION ALL
        SELECT doc_id, i, CASE WHEN fits THEN first ELSE greatest(i - ((i - first) * {numerator}) // {denominator}, least_first) END, no + (NOT fits)::INT, (NOT fits)::INT
        FROM (
            SELECT s.doc_id, s.i + 1 AS i, s.first, s.no, c.upto - a.upto + a.n <= {room} AS fits,
                   (SELECT min(z.u) FROM units z WHERE z.doc_id = s.doc_id AND z.u <= s.i + 1 AND c.upto - z.upto + z.n <= {room}) AS least_first
            FROM step s JOIN units c ON c.doc_id = s.doc_id AND c.u = s.i + 1 JOIN units a ON a.doc_id = s.doc_id AND a.u = s.first)),
    runs AS (
        SELECT r.doc_id, CAST(r.no AS INT) AS seq_no, r.first, r.last, b.upto - a.upto + a.n AS n_tokens, a.sent_id AS first_sent, a.sub AS first_sub, b.sent_id AS last_sent, b.sub AS last_sub
        FROM (SELECT doc_id, no, max(first) AS first, max(i) AS last FROM step GROUP BY doc_id, no) r
        JOIN units a ON a.doc_id = r.doc_id AND a.u = r.first JOIN units b ON b.doc_id = r.doc_id AND b.u = r.last)"""


def pooled(chunks: str, context: float = 0.5) -> str:
    """Chunks (doc_id, key columns, first_sent, last_sent) pooled over whole documents: n_tokens and e0, e1, ..."""
    return f"""
    docsum AS (SELECT doc_id, sum(n) AS dn, {", ".join(f"sum(v{d}) AS c{d}" for d in range(D))} FROM sums GROUP BY doc_id),
    pool AS (
        SELECT k.*, p.n_tokens, {", ".join(rounded(f"CASE WHEN p.n_tokens = 0 THEN 0 ELSE p.t{d} / p.n_tokens + {context} * (c{d} / dn) END", 6) + f" AS e{d}" for d in range(D))}
        FROM {chunks} k
        JOIN (SELECT k.doc_id, k.first_sent, k.last_sent, sum(s.n) AS n_tokens, {", ".join(f"sum(s.v{d}) AS t{d}" for d in range(D))}
              FROM (SELECT DISTINCT doc_id, first_sent, last_sent FROM {chunks}) k JOIN sums s ON s.doc_id = k.doc_id AND s.sent_id BETWEEN k.first_sent AND k.last_sent GROUP BY ALL) p
        USING (doc_id, first_sent, last_sent) JOIN docsum USING (doc_id))"""


def query_vectors(table: str, id_col: str, prompt: str = "", where: str = "true", context: float = 0.5) -> str:
    """qvec(id, n_tokens, e0, ...): a text's mean token vector plus ``context`` times the same."""
    return f"""
    qtok AS (SELECT id, {_NIBBLES} FROM (SELECT id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM (
        SELECT {id_col} AS id, unnest(regexp_extract_all(lower('{prompt}' || text), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {table} WHERE {where}))),
    qvec AS (SELECT id, {", ".join(f"sum(x{d}) / count(*) + {context} * (sum(x{d}) / count(*)) AS e{d}" for d in range(D))} FROM qtok GROUP BY id)"""
