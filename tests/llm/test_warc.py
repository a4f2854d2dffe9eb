import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import warc as wa

SCHEMA = "page_id long, url string, html string, key string, file string, offset long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", 1, "d") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/A?b=1#c", "com,example,www)/A?b=1"),
        ("https://a.org", "org,a)/"),
        ("https://a.org?x", "org,a)/?x"),
        ("http://a.org:80/x", "org,a)/x"),
        ("http://a.org:8080/x", "org,a:8080)/x"),
        ("HTTPS://u:p@a.org:443/", "org,a)/"),
        ("no url", None),
        ("", None),
        (None, None),
    ],
)
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(wa.url_key(F.col("url"))).first()[0] == key


def test_whole_archive_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(3)
    a = wa.write_archive(pages, f"file://{tmp_path}/w", block_lines=7)
    want = {(r.page_id, r.url, r.html) for r in pages.collect()}
    keys = pages.select(wa.url_key(F.col("url")))
    got = wa.look_up(a, keys).collect()
    assert {(r.page_id, r.url, r.html) for r in got} == want and len(got) == len(want) == a.captures
    every = wa.read_warc(spark, f"file://{tmp_path}/w/*.warc.gz").collect()
    assert {(r.page_id, r.url, r.html) for r in every} == want and len(every) == len(want)
    for f in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.0\r\n") == sum(r.file.endswith(f.name) for r in every)
    lines = []
    for first, name in a.shards:
        own = gzip.decompress((tmp_path / "w" / f"{name}.cdx.gz").read_bytes()).decode().splitlines()
        assert own[0].startswith(f'["{first}"')
        lines += [x.split('"')[1] for x in own]
    assert lines == sorted(lines)


def test_a_look_up_reads_few_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 50:02d}.org/{i:05d}", f"page {i}") for i in range(2000)]
    a = wa.write_archive(frame(spark, rows), f"file://{tmp_path}/w", block_lines=10)
    for i in (0, 777, 1999):
        r = wa.Reader(a)
        (c,) = r.captures(f"org,h{i % 50:02d})/{i:05d}")
        assert c[1] == str(i) and r.range_reads <= 2
        assert r.fetch(*c[3:6])["body"] == f"page {i}".encode()
    r = wa.Reader(a)
    for key in ("aaa", "org,h00)/99999", "zzz)", ""):
        assert r.captures(key) == []


def test_many_captures_of_a_key(spark, tmp_path):
    rows = [(i, "http://same.org/x", f"v{i}") for i in range(95)] + [(200, "http://a.org/", "a"), (201, "http://z.org/", "z")]
    a = wa.write_archive(frame(spark, rows).repartition(4), f"file://{tmp_path}/w", block_lines=10)
    got = wa.look_up(a, spark.createDataFrame([("org,same)/x",), ("org,same)/x",), (None,), ("org,none)/",)], "k string")).collect()
    assert sorted(r.page_id for r in got) == list(range(95))


def test_odd_and_empty(spark):
    big = "<p>" + "ü" * 3_000_000
    rows = [(None, "http://a.org/1", "x"), (1, None, "y"), (2, "", "z"), (3, "http://a.org/3", None), (4, "http://a.org/4", ""), (5, "http://a.org/5#a", "same"), (5, "http://a.org/5#a", "same"), (6, "http://a.org/6ü\n", big), (7, "mailto:x", "n")]
    got = wa.round_trip(frame(spark, rows)).collect()
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    want = [(i, u, None if h is None else len(h), md5(h)) for i, u, h in rows if u and "://" in u]
    assert sorted(((r.page_id, r.url, r.html_chars, r.html_md5) for r in got), key=str) == sorted(want, key=str)
    assert wa.round_trip(frame(spark, rows).where("false")).collect() == []


def test_damage_is_found():
    data, _ = wa.record(1, "http://a.org/", "hello")
    assert wa.parse(data)["body"] == b"hello"
    with pytest.raises(ValueError):
        wa.parse(gzip.compress(gzip.decompress(data).replace(b"hello", b"hellO")))
    with pytest.raises(ValueError):
        wa.parse(gzip.compress(gzip.decompress(data)[:-3]))


def test_page_ids_of_any_type(spark, tmp_path):
    rows = [("p 1%", "http://a.org/1", "x"), ("", "http://a.org/2", "y"), (None, "http://a.org/3", None), ("\u00fc\r\n ", "http://a.org/1", "z")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    a = wa.write_archive(pages, f"file://{tmp_path}/w")
    keys = pages.select(wa.url_key(F.col("url")).alias("k"))
    assert sorted(map(str, ((r.page_id, r.url, r.html) for r in wa.look_up(a, keys).collect()))) == sorted(map(str, rows))
    every = wa.read_warc(spark, f"file://{tmp_path}/w/data-*.warc.gz", "string").collect()
    assert sorted(map(str, ((r.page_id, r.url, r.html) for r in every))) == sorted(map(str, rows))
