import re

import pytest

from chunkloom.llm import urls as ur


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("||example.com^", ["http://example.com/", "https://a.example.com:80/x", "http://example.com"], ["http://notexample.com/", "http://x.org/?http://example.com/"]),
        ("/ads/*", ["http://x.org/ads/1"], ["http://x.org/ads"]),
        ("|http://*/en/", ["http://a/b/en/"], ["https://a/en/"]),
        (".html|", ["http://a/x.HTML"], ["http://a/x.html?y"]),
        ("^casino^", ["http://a/casino/", "http://casino?x", "http://a/casino"], ["http://a/casinos", "http://a/-casino"]),
        ("a+b(c)$", ["http://x/a+b(c)$"], ["http://x/aab"]),
    ],
)
def test_patterns(pattern, yes, no):
    p = re.compile(ur.regex(pattern))
    assert all(p.search(u.lower()) for u in yes) and not any(p.search(u.lower()) for u in no)


def test_every_match_has_every_literal_token(spark):
    pages = [r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    for rule in ur.RULES:
        need, p = set(ur.literal_tokens(rule)), re.compile(ur.regex(rule))
        for u in pages:
            if p.search(u.lower()):
                assert need <= set(re.findall("[a-z0-9]+", u.lower())), (rule, u)
    assert ur.literal_tokens("||ads.*^") == ["ads"] and ur.literal_tokens("7777") == [] and ur.literal_tokens("x/ab*") == [] and ur.literal_tokens("@@/en/*feed") == ["en"]


def brute(rows, rules):
    out = set()
    for i, u in set(rows):
        hit = [n for n, r in enumerate(rules) if u is not None and re.search(ur.regex(r), u.lower())]
        verdict = "allow" if any(rules[n].startswith("@@") for n in hit) else "block" if hit else "none"
        out.add((i, u, verdict, len(hit), ",".join(map(str, hit))))
    return out


def test_equals_all_rules_on_all_urls(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url) for r in df.collect()]
    got = [tuple(r) for r in ur.filtered(df).collect()]
    assert set(got) == brute(rows, ur.RULES) and len(got) == len(set(rows)) and len({g[2] for g in got}) == 3


def test_rarest_token_is_the_key(spark):
    df = spark.createDataFrame([(i, f"http://common.org/page/{'rare' if i == 0 else 'x'}") for i in range(5)], "page_id long, url string")
    assert ur.rule_index(df, ["||common.org/page/rare|", "*", "/page/common/"])[0][0] == "rare"
    assert [r[0] for r in ur.rule_index(df, ["7*7", "/zz/yy/"])] == [None, "yy"]


def test_odd_and_empty(spark):
    rows = [(None, "http://a.org/ads/1"), (1, None), (1, None), (2, ""), (3, "http://a.org/" + "x/" * 50_000 + "ads/"), (4, "no url"), (5, "HTTP://A.ORG/ADS/7777"), (5, "HTTP://A.ORG/ADS/7777")]
    df = spark.createDataFrame([(*r, "z", "y", 1) for r in rows], "page_id long, url string, low string, token string, rule int")
    got = [tuple(r) for r in ur.filtered(df).collect()]
    assert set(got) == brute(rows, ur.RULES) and len(got) == 6
    assert ur.filtered(df.where("false")).collect() == []
    assert {r.verdict for r in ur.filtered(df, rules=[]).collect()} == {"none"}
