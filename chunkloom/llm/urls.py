"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in which ``*`` is any run of characters, ``^`` a separator or the end, a leading ``||`` a scheme and any
subdomains, a leading or trailing ``|`` the start or end of the URL; ``@@`` in front makes it an exception.  A literal token of a rule is a run of
letters and digits that every matching URL has as a whole token.  Of these the one that the fewest URLs have is the rule's index key.
A URL's tokens fetch its candidate rules by an equi-join and only those run their regular expression; rules
without a literal token are tried on every URL.  All of it stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import columns

RULES: tuple[str, ...] = (
    "||ads.*^", "||adserver.*^", "||track.*^", "||doubleclick.*^", "||m.*.example.org^", "/ads/*", "/banner/*", "/banners/*", "/popunder.", "/pixel.gif?",
    "/tracking/*", "/beacon/*", "?utm_source=feed^", "&utm_source=", "?affiliate=", "&ref=x|", "/search?q=*&page=", "/login^", "/cart^", "/wp-admin/*",
    "/de/1*.html|", "/fr/2*.html|", "||blog.*.example.net/es/", "||blog.*^en^*#top|", "|http://*/en/*5/|", "^casino^", "^poker^", "^xxx^", "^adult^", "^viagra^",
    "||example.biz^", "||thering.example.com^", "||tionsh.example.net/de/", "||therwh.example.org^fr^", "/session/*/token/", ".exe|", ".zip|", "#top|", "99*9?page=", "7777",
    "@@||blog.*^", "@@/en/*utm_source=feed", "@@||m.therst.example.com^", "@@.html|",
)
#: Characters of rules that are sent to all tasks.
MOST_BROADCAST = 8 << 20
_SEPARATOR = "(?:[^a-z0-9_.%-]|$)"


def regex(pattern: str) -> str:
    """The regular expression of a pattern, for lower-cased URLs; Java, RE2 and Python read it alike."""
    p = pattern.removeprefix("@@").lower()
    head = tail = ""
    if p.startswith("||"):
        head, p = "^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?", p[2:]
    elif p.startswith("|"):
        head, p = "^", p[1:]
    if p.endswith("|"):
        tail, p = "$", p[:-1]
    return head + "".join(".*" if c == "*" else _SEPARATOR if c == "^" else c if c.isalnum() else f"[{c}]" if c not in "\\[]^" else "\\" + c for c in p) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits with a boundary on both sides in every match."""
    p = pattern.removeprefix("@@").lower()
    left = right = False
    if p.startswith("||"):
        left, p = True, p[2:]
    elif p.startswith("|"):
        left, p = True, p[1:]
    if p.endswith("|"):
        right, p = True, p[:-1]
    out = []
    for m in re.finditer("[a-z0-9]+", p):
        a, b = m.span()
        before = left if a == 0 else p[a - 1] != "*" and p[a - 1].isascii()
        after = right if b == len(p) else p[b] != "*" and p[b].isascii()
        if before and after:
            out.append(m[0])
    return list(dict.fromkeys(out))


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_index(pages: DataFrame, rules: Sequence[str] = RULES, url_col: str = "url") -> list[tuple[str | None, int, bool, str]]:
    """(index token, rule number, exception, regular expression); the token is the rarest among all URLs of
    the table, on a tie the first in alphabetical order, and null for a rule without one."""
    found = [literal_tokens(r) for r in rules]
    every = sorted({t for ts in found for t in ts})
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in every], "token string")
    has = columns(pages, url_col).toDF("url").select(F.explode(tokens(F.col("url"))).alias("token"))
    seen = {r.token: r.n for r in has.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [(min(ts, key=lambda t: (seen.get(t, 0), t)) if ts else None, n, r.startswith("@@"), regex(r)) for n, (r, ts) in enumerate(zip(rules, found))]


def filtered(pages: DataFrame, rules: Sequence[str] = RULES, most: int = MOST_BROADCAST, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, verdict, n_rules, rules) for each distinct pair of id and URL.

    ``verdict`` is ``allow`` if an exception matches, else ``block`` if a rule does, else ``none``; ``rules`` are the numbers of all that match, ascending, joined by commas.
    A null or empty URL matches no rule.  Other columns are not read.  Rules of at most ``most`` characters go to all tasks; more of them meet the URLs in a
    shuffled join.
    """
    spark = pages.sparkSession
    index = rule_index(pages, rules, url_col)
    keyed = spark.createDataFrame([r for r in index if r[0] is not None], "token string, rule int, exception boolean, pattern string")
    if sum(len(r[3]) for r in index) <= most:
        keyed = F.broadcast(keyed)
    one = lambda rule, exception: F.struct(F.lit(rule).alias("rule"), F.lit(exception).alias("exception"))
    base = columns(pages, id_col, url_col).toDF("page_id", "url").withColumn("low", F.lower("url"))
    # Rules without a token run on every URL, once, beside its tokens: their patterns are constants, compiled once a task.
    always = F.array_compact(F.array(*(F.when(F.col("low").rlike(p), one(n, e)) for t, n, e, p in index if t is None), F.lit(None).cast("struct<rule: int, exception: boolean>")))
    hits = base.select("page_id", "url", "low", F.explode_outer(tokens(F.col("url"))).alias("token")).join(keyed, "token", "left")
    hits = hits.select("page_id", "url", F.when(F.col("low").isNotNull() & F.expr("low rlike pattern"), F.struct("rule", "exception")).alias("hit"))
    if any(t is None for t, *_ in index):
        hits = hits.unionByName(base.select("page_id", "url", F.explode(always).alias("hit")))
    out = hits.groupBy("page_id", "url").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    return out.select(
        "page_id", "url",
        F.when(F.exists("hits", lambda h: h.exception), "allow").when(F.size("hits") > 0, "block").otherwise("none").alias("verdict"),
        F.size("hits").cast("bigint").alias("n_rules"),
        F.array_join(F.transform("hits", lambda h: h.rule.cast("string")), ",").alias("rules"),
    )


def oracle(rules: Sequence[str] = RULES) -> str:
    """The same in SQL, every rule on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {str(r.startswith('@@')).lower()}, {q(regex(r))})" for n, r in enumerate(rules))
    return f"""
    WITH rules(rule, exception, pattern) AS (VALUES {values}),
    base AS (SELECT DISTINCT page_id, url FROM pages),
    hits AS (SELECT page_id, url, rule, exception FROM base JOIN rules ON regexp_matches(lower(url), pattern))
    SELECT b.page_id, b.url,
           CASE WHEN bool_or(h.exception) THEN 'allow' WHEN count(h.rule) > 0 THEN 'block' ELSE 'none' END AS verdict,
           count(h.rule) AS n_rules, coalesce(string_agg(CAST(h.rule AS VARCHAR), ',' ORDER BY h.rule), '') AS rules
    FROM base b LEFT JOIN hits h ON b.page_id IS NOT DISTINCT FROM h.page_id AND b.url IS NOT DISTINCT FROM h.url
    GROUP BY b.page_id, b.url"""
