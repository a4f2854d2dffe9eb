import struct

import numpy as np
import pytest

from chunkloom.api import LateChunker
from chunkloom.config import Options
from chunkloom.operators import encoders as en
from chunkloom.operators import onnx
from chunkloom.operators.tokenizer import VocabularyTokenizer

BPE = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [
    (1, "Machine learning is AI. It enables learning."), (2, " ".join(f"This is sentence number {i}." for i in range(60))), (3, "Short. " + "many repeated words " * 60 + ". The end."),
    (4, None), (5, ""), (6, " \n"), (7, "..."), (8, "\n\n  Ünïcode 日本語 text! \t 😀 and so on ..  Last"), (9, "<|endoftext|> is text here."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def field(n, v):
    """A field of a protocol buffer."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """An ONNX model whose token vectors are rows of a table, and the table."""
    table = np.random.default_rng(1).integers(-8, 9, (60_000, 5)).astype(np.float32)

    def value(name, kind, dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d.encode())) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    node = field(1, b"table") + field(1, b"input_ids") + field(2, b"out") + field(3, b"g") + field(4, b"Gather")
    tensor = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, b"table") + field(9, table.tobytes())
    graph = field(1, node) + field(2, b"graph") + field(5, tensor) + field(11, value(b"input_ids", 7, ("n", "w"))) + field(12, value(b"out", 1, ("n", "w", 5)))
    path = tmp_path_factory.mktemp("onnx") / "m.onnx"
    path.write_bytes(field(1, 8) + field(8, field(1, b"") + field(2, 13)) + field(7, graph))
    return str(path), table


KEY = ("doc_id", "chunk_idx", "max_chunk_tokens", "num_sents", "first_sent", "last_sent", "is_split", "n_tokens", "chunk")


def rows(df):
    return sorted((tuple(r[k] for k in KEY), tuple(r.embedding)) for r in df.collect())


@pytest.mark.parametrize("how", [{"max_chunk_sents": 2, "keep_tail": True}, {"max_length": 32, "max_chunk_tokens": 12, "max_chunk_sents": None}, {"max_length": 64, "exclude_special_tokens": False, "prompt": ""}])
def test_results_do_not_depend_on_batches(docs, model, how):
    tok = VocabularyTokenizer(BPE, cls="<|endoftext|>", sep="<|endoftext|>")
    chunker = LateChunker(Options(), onnx.OnnxEncoder(model[0]), tok)
    one = rows(chunker.encode(docs.coalesce(1), **how))
    assert one and one == rows(chunker.encode(docs.repartition(4), max_batch_tokens=64, **how)) == rows(chunker.encode(docs, max_batch_tokens=1, **how))


def test_pooling_by_a_model_equals_loops(docs, model):
    path, table = model
    tok = VocabularyTokenizer(BPE)
    got = rows(LateChunker(encoder=onnx.OnnxEncoder(path, max_length=None), tokenizer=tok).encode(docs, max_length=4096, prechunk=False))
    text = dict(TEXTS)
    for i, t in TEXTS:
        own = [(k, e) for k, e in got if k[0] == i]
        if not own:
            assert i in (4, 5, 6, 7)
            continue
        ids, _, _ = tok([t])
        assert sum(k[7] for k, _ in own) == len(ids) and tok.decode(ids) == text[i]
        at = 0
        for k, e in own:
            assert np.allclose(e, table[ids[at : at + k[7]]].mean(axis=0))
            at += k[7]


def test_split_chunks_are_cut_at_their_tokens(docs, model):
    tok = VocabularyTokenizer(BPE)
    got = LateChunker(encoder=onnx.OnnxEncoder(model[0]), tokenizer=tok).encode(docs.where("doc_id = 3"), max_chunk_sents=None, max_chunk_tokens=16, prechunk_overlap=0.0, max_length=64, count_specials=False).orderBy("chunk_idx").collect()
    assert sum(r.is_split for r in got) > 8 and all(r.n_tokens <= 16 for r in got)
    assert "".join(r.chunk for r in got).replace(" ", "") == TEXTS[2][1].replace(" ", "")
    assert all(r.chunk in TEXTS[2][1] for r in got if r.is_split)


def test_queries_by_a_model(spark, model):
    path, table = model
    tok = VocabularyTokenizer(BPE, cls="<|endoftext|>", max_length=6)
    q = spark.createDataFrame([(1, "find this"), (2, None), (3, ""), (4, "a much longer query than the model can take in")], "query_id long, text string")
    chunker = LateChunker(encoder=onnx.OnnxEncoder(path, max_length=None), tokenizer=tok)
    got = {r.query_id: r.embedding for r in chunker.encode_queries(q).collect()}
    ids = tok(["a much longer query than the model can take in"])[0][:5]
    assert got[2] == got[3] == [0.0] * 5 and np.allclose(got[4], table[ids].mean(axis=0)) and np.allclose(got[1], table[tok(["find this"])[0]].mean(axis=0))
    with_cls = {r.query_id: r.embedding for r in chunker.encode_queries(q, exclude_special_tokens=False).collect()}
    assert np.allclose(with_cls[4], table[[tok.ends[0], *ids]].mean(axis=0))


def test_limits_and_errors(docs, model):
    path, _ = model
    enc = onnx.OnnxEncoder(path, max_length=128, dtype="float16")
    tok = VocabularyTokenizer(BPE, max_length=100)
    c = LateChunker(encoder=enc, tokenizer=tok)
    assert c.max_length() == 100 and LateChunker().max_length() == 512 and LateChunker(encoder=enc).max_length() == 128 and c.max_length(64) == 64
    with pytest.raises(ValueError, match="exceeds"):
        c.encode(docs, max_length=101)
    for bad in (lambda: onnx.OnnxEncoder(path, dtype="int8"), lambda: onnx.get_device("tpu"), lambda: onnx.get_device("cuda", ["CPUExecutionProvider"]), lambda: VocabularyTokenizer(BPE, cls="[nothing]"), lambda: tok.check(np.array([tok.size]))):
        with pytest.raises(ValueError):
            bad()
    assert onnx.get_device(None, ["CPUExecutionProvider"]) == "cpu" and onnx.get_device(None, ["CUDAExecutionProvider", "CPUExecutionProvider"]) == "cuda"
    v, _ = enc.encode(np.array([[1, 2]]), np.ones((1, 2), dtype=bool), np.zeros((1, 2), dtype=bool))
    assert v.dtype == np.float16 and enc.half().dtype == "float16" and enc.to("cpu").device == "cpu"


def test_batches_are_padded_and_masked():
    seen = []

    class Sums:
        dim = 1

        def encode(self, ids, mask, special):
            seen.append((ids.copy(), mask.copy(), special.copy()))
            return np.where(mask, ids, 999)[..., None].astype(float), None

    got = {}
    flat, lo, hi = np.arange(1, 31), np.array([0, 3, 4, 4]), np.array([3, 4, 4, 24])
    en.run_batches(Sums(), flat, lo, hi, np.array([77]), (101, 102), 0, 32, lambda own, first, v, a, z, c: got.update({int(k): (v[f : f + hi[k] - lo[k], 0].tolist(), a[i, 0], z[i, 0]) for i, (k, f) in enumerate(zip(own, first))}))
    assert got == {k: (flat[lo[k] : hi[k]].tolist(), 101, 102) for k in range(4)}
    for ids, mask, special in seen:
        assert ids.shape[1] & ids.shape[1] - 1 == 0 and (len(ids) == 1 or ids.size <= 32) and (ids[~mask] == 0).all() and not (special & ~mask).any()
        assert (ids[:, 1] == 77).all() and (ids[:, 0] == 101).all() and (special.sum(axis=1) == 2).all()
    assert [len(i) for i, *_ in seen] == [1, 3]


def test_normalised_means_are_shorter_unless_asked(docs):
    how = {"max_length": 32, "max_chunk_sents": 1}
    d = docs.where("doc_id = 2")
    plain, again = (LateChunker(Options(normalize=True, renormalize=r)).encode(d, **how).collect() for r in (False, True))
    assert np.allclose([np.linalg.norm(r.embedding) for r in again], 1) and min(np.linalg.norm(r.embedding) for r in plain) < 1 - 1e-6


def test_wrong_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        VocabularyTokenizer("/nowhere.json")
    (tmp_path / "x").write_bytes(struct.pack("<q", 1))
    with pytest.raises(Exception):
        onnx.OnnxEncoder(str(tmp_path / "x"))
