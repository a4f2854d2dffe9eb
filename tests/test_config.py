import logging

import pytest

from chunkloom import config as c
from chunkloom.sources import tables


def test_configs():
    assert c.configs([1, 2], None) == [c.ChunkConfig(1, None), c.ChunkConfig(2, None)]
    assert c.configs([1, 2], 64) == [c.ChunkConfig(1, 64), c.ChunkConfig(2, 64)]
    assert c.configs([1, None], [None, 64]) == [c.ChunkConfig(1, None), c.ChunkConfig(None, 64)]
    for bad in (([], None), ([1, 2], [3]), (None, None), ([1, None], None), (0, None), (None, 0), (None, 600)):
        with pytest.raises(ValueError):
            c.configs(*bad, max_length=512)
    with pytest.raises(TypeError):
        c.configs(1.5, None)
    with pytest.raises(TypeError):
        c.configs(None, "8")


def test_single_values():
    for bad in (-1, 0.5, True):
        with pytest.raises(TypeError):
            c.overlap_sents(bad)
    for good in (0, 0.0, 0.5, 10):
        c.prechunk_overlap(good)
    for bad in (1.0, -0.1, -1, "x"):
        with pytest.raises(ValueError):
            c.prechunk_overlap(bad)
    with pytest.raises(ValueError, match="Invalid method"):
        c.member("method", "x", c.SEGMENTERS)
    with pytest.raises(ValueError):
        c.Options(dim=0)
    with pytest.raises(TypeError):
        c.Options(truncate_dims=1.5)


def test_jobs_and_logging(caplog, monkeypatch):
    monkeypatch.setattr("os.cpu_count", lambda: 4)
    assert [c.num_jobs(n) for n in (None, 0, 1, 4, 9, -1, -2, -9)] == [1, 1, 1, 4, 4, 4, 3, 1]
    log = c.configure_logging(logging.INFO)
    log.addHandler(caplog.handler)
    with c.timer("work"):
        pass
    assert "work took" in caplog.text
    c.configure_logging(logging.WARNING, stream=False)


def test_documents(spark):
    df = tables.from_strings(spark, ["a", ""])
    c.documents(df, "doc_id", "text")
    assert [tuple(r) for r in df.collect()] == [(0, "a"), (1, "")]
    with pytest.raises(ValueError):
        tables.from_strings(spark, [])
    with pytest.raises(TypeError):
        tables.from_strings(spark, ["a", 1])
    with pytest.raises(ValueError):
        c.documents(df, "doc_id", "body")
    with pytest.raises(TypeError):
        c.documents(df, "doc_id", "doc_id")
    with pytest.raises(TypeError):
        c.documents(["a"], "doc_id", "text")


def test_sources_and_sinks(spark, tmp_path):
    df = tables.from_strings(spark, ["One. Two.", "Three."])
    for f in ("parquet", "orc", "json"):
        tables.write(df, f"{tmp_path}/{f}", f)
        assert sorted(map(tuple, tables.read(spark, f"{tmp_path}/{f}", f, "doc_id bigint, text string").collect())) == [(0, "One. Two."), (1, "Three.")]
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xls")
    with pytest.raises(ValueError):
        tables.write(df, "x", "xls")
