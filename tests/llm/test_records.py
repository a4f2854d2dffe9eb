import random

import numpy as np
import pytest

from chunkloom.llm import records as rc
from chunkloom.llm import tokenizer as tk


def slow_crc(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    r = random.Random(1)
    parts = [b"123456789", *(r.randbytes(r.randint(4, 70)) for _ in range(200))]
    assert rc.crc32c(parts).tolist() == [slow_crc(p) for p in parts]
    assert rc.crc32c([b"123456789"])[0] == 0xE3069283
    assert rc.masked(np.array([0], dtype=np.uint32))[0] == 0xA282EAD8
    with pytest.raises(ValueError):
        rc.crc32c([b"abc"])


def test_round_trip_in_shuffled_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    index = rc.write_records(docs, f"file://{tmp_path}/r")
    enc = tk.encoding()
    text = {r.doc_id: r.text for r in docs.collect()}
    back = rc.read_records(index, seed=5).collect()
    assert {r.doc_id: enc.decode(r.ids) for r in back} == text and len(back) == len(text)
    assert all(r.n_tokens == len(r.ids) for r in back)
    assert [r.doc_id for r in rc.read_records(index, seed=6).collect()] != [r.doc_id for r in back]
    rows = index.orderBy("shard", "record").collect()
    for shard in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == shard]
        raw = (tmp_path / "r" / shard).read_bytes()
        assert own[0].offset == 0 and own[-1].offset + own[-1].length == len(raw)
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
        assert rc.parse(raw[own[0].offset : own[0].offset + own[0].length])[0] == own[0].doc_id


def test_damage_is_found():
    (good,), _ = rc.frames([rc.payload(3, "some text", tk.VOCABULARY)])
    assert rc.parse(good)[0] == 3
    for i in range(len(good)):
        with pytest.raises(ValueError):
            rc.parse(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError):
        rc.parse(good[:-1])


def test_odd_and_empty(odd, empty):
    index = rc.write_records(odd)
    assert index.count() == odd.count()
    enc = tk.encoding()
    got = sorted((str(r.doc_id), None if r.ids is None else enc.decode(r.ids)) for r in rc.read_records(index).collect())
    assert got == sorted((str(r.doc_id), r.text) for r in odd.select("doc_id", "text").collect())
    assert rc.write_records(empty).collect() == []


def test_tokens_equal_the_public_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for s in ("Hello  world\n\n it's 3,5 %", "ünïcödé 日本語 <|endoftext|>", " lead", ""):
        t.encode_special_tokens = True
        assert tk.token_ids(s).tolist() == t.encode(s, add_special_tokens=False).ids
    with pytest.raises(FileNotFoundError):
        tk.encoding("/nowhere.tiktoken")


def test_ids_of_any_type_and_shards_of_lost_attempts(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "shard-000000-99.bin").write_bytes(b"of an attempt that was lost")
    rows = [("a-1", "some text"), ("", "no name"), (None, "no id"), ("\u00fc\n", None), ("a-1", "some text")]
    index = rc.write_records(spark.createDataFrame(rows, "doc_id string, text string").repartition(2), f"file://{tmp_path}/r")
    back = rc.read_records(index)
    assert back.schema["doc_id"].dataType.simpleString() == "string"
    enc = tk.encoding()
    assert sorted(str((r.doc_id, None if r.ids is None else enc.decode(r.ids))) for r in back.collect()) == sorted(map(str, rows))
    assert {p.name for p in (tmp_path / "r").glob("shard-*")} == {r.shard for r in index.collect()}
    dates = spark.sql("select date'2024-01-05' as doc_id, 'x' as text union all select null, 'y'")
    got = rc.read_records(rc.write_records(dates))
    assert got.schema["doc_id"].dataType.simpleString() == "date" and sorted(str(r.doc_id) for r in got.collect()) == ["2024-01-05", "None"]
