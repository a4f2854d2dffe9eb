import os
import shutil

import pytest

import corpus_pipeline as cp
from chunkloom.llm import contamination, language, near_text, packing, private, queries

from .test_contamination import brute as brute_leaks
from .test_near_text import brute_groups
from .test_packing import rebuilt, wanted


def test_stages_equal_brute_force(spark, prose, table, tmp_path):
    """Each stage's result, worked out in plain Python from what the stage before it kept."""
    rows = [(i, prose(i, 40 + 7 * i)) for i in range(40)] + [(100 + i, prose(i, 40 + 7 * i) + " tail") for i in range(5)] + [(200, None), (201, ""), (202, "12 34"), (203, prose(5, 30) + " mail x.y@z.org " + prose(6, 30))]
    items = [(1, prose(7, 30)), (2, prose(1234, 25))]
    rows.append((300, prose(50, 40) + " " + items[1][1] + " " + prose(51, 40)))
    d = str(tmp_path)
    table(rows, extra=False).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    named = dict(cp.STAGES)
    text = dict(rows)
    have = {i for i, t in rows if t and any(c.isalpha() for c in t)}
    one = named["language_id"](spark, docs, d)
    assert {r.doc_id for r in one.collect()} == have
    groups = brute_groups([(i, text[i]) for i in have])
    have -= {i for i, keep, _ in groups if i != keep}
    two = named["minhash_near_dedup"](spark, one, d)
    assert {r.doc_id for r in two.collect()} == have
    have -= {i for i, *_ in brute_leaks([(i, text[i]) for i in have], items)}
    three = named["decontamination"](spark, two, d)
    assert {r.doc_id for r in three.collect()} == have and 300 not in have and 7 not in have
    four = named["pii"](spark, three, d)
    clean = {i: private.redact(text[i], private.find(text[i])) for i in have}
    assert {r.doc_id: r.text for r in four.collect()} == clean and "<EMAIL>" in clean[203]
    assert all(x.columns == docs.columns for x in (one, two, three, four))
    five = named["packing"](spark, four, d)
    assert rebuilt(five.collect(), packing.CAPACITY) == wanted(clean.items())
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, five.collect()))


def test_odd_and_empty(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "a test item of more than five words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (odd, empty):
        for name, stage in cp.STAGES:
            df2 = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert df2.columns == df.columns
            df2.collect()
            df = df2 if name != "packing" else df


def test_registered():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 11
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["language_id", "minhash_near_dedup", "decontamination", "pii", "packing"]
    assert contamination and language and near_text


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, d).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_the_rest_works_without_this_subpackage(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, f"{tmp_path}/r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=f"{tmp_path}/r", check=True)
