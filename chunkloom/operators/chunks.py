"""Sequences, chunk windows, pooling: from documents to embedded chunks without a shuffle.

Sentences and tokens are array columns of the document's row.  One Arrow pass plans sequences and chunks for all
configurations and pools them from a single encoding of each sequence; only chunk rows leave it, never token vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import ChunkConfig, Options
from chunkloom.functions import layout
from chunkloom.operators import text as tx
from chunkloom.operators.encoders import HashContextEncoder, TokenEncoder, batched, hash_token, run_batches, token_hash
from chunkloom.operators.slices import sliced
from chunkloom.operators.tokenizer import VocabularyTokenizer

PLAN = "config_no int, chunk_no int, seq_no int, first_sent int, last_sent int, num_sents int, is_split boolean, n_tokens int, tok_lo int, tok_hi int, sent_lo int, opens boolean, closes boolean"
#: Where a chunk's tokens are in the text, if a tokenizer with a vocabulary says so, else -1.
PLACES = "char_lo int, char_hi int"
_PLAN_TYPE = pa.struct([(n, {"int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in PLAN.split(", "))])
CLS, SEP = "[CLS]", "[SEP]"
#: What a token and a sentence's count add to the cost of a slice, see ``slices``: chunks are tuples while they are planned.
_OF_TOKEN, _OF_COUNT = 2, 16


def windows(n: Column, size: int, overlap: float | int = 0, keep_tail: bool = False) -> Column:
    """array<struct<first,last>> of sliding sentence windows, as an expression over a number of sentences."""
    step = size - layout.overlap_count(overlap, size)
    have = F.least(F.lit(size), n)
    none = F.array().cast("array<struct<first: int, last: int>>")
    whole = F.transform(F.sequence(F.lit(0), n - have, F.lit(step)), lambda s: F.struct(s.cast("int").alias("first"), (s + have - 1).cast("int").alias("last")))
    if keep_tail:
        end = F.element_at(whole, -1)
        whole = F.when(end["last"] < n - 1, F.concat(whole, F.array(F.struct((end["first"] + step).cast("int").alias("first"), (n - 1).cast("int").alias("last"))))).otherwise(whole)
    return F.when(n > 0, whole).otherwise(none)


def greedy_chunks(counts: Column, most: int, sents: int | None = None, overlap: int = 0, split: bool = True) -> Column:
    """array<struct<first,last,piece,n_tokens>> of token-budget chunks over an array of tokens a sentence."""
    item = pa.struct([(n, pa.int32()) for n in ("first", "last", "piece", "n_tokens")])

    @sliced("array<struct<first: int, last: int, piece: int, n_tokens: int>>", _OF_COUNT)
    def run(rows: pa.Array) -> pa.Array:
        return _structs([layout.greedy(r or [], most, sents, overlap, split) for r in rows.to_pylist()], item)

    return run(counts)


def packed_sequences(counts: Column, room: int, overlap: float | int = 0.5) -> Column:
    """array<struct<seq_no,first_sent,first_sub,last_sent,last_sub,n_tokens>>: runs of whole sentences, or pieces of those beyond ``room``, that fit."""
    names = ("seq_no", "first_sent", "first_sub", "last_sent", "last_sub", "n_tokens")
    item = pa.struct([(n, pa.int32()) for n in names])

    @sliced("array<struct<seq_no: int, first_sent: int, first_sub: int, last_sent: int, last_sub: int, n_tokens: int>>", _OF_COUNT)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            us = layout.units(r or [], room)
            seqs = layout.sequences([u.n for u in us], room, overlap)
            out.append([(k, us[a].sent, us[a].sub, us[b].sent, us[b].sub, us[b].lo + us[b].n - us[a].lo) for k, (a, b) in enumerate(seqs)])
        return _structs(out, item)

    return run(counts)


def _structs(rows: list[list[tuple]], item: pa.StructType) -> pa.Array:
    """A list column of structs of whole numbers, from flat columns."""
    flat = np.array([x for r in rows for x in r], dtype=np.int32).reshape(-1, len(item))
    fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(len(item))], fields=list(item))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), fields)


def long_units(counts: Column, length: int) -> Column:
    """array<struct<sent,sub,n>>: sentences cut every ``length`` tokens, in the JVM."""
    pieces = F.transform(
        counts,
        lambda n, s: F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / length).cast("int") - 1)),
            lambda p: F.struct(s.cast("int").alias("sent"), p.cast("int").alias("sub"), F.least(F.lit(length), n - p * length).cast("int").alias("n")),
        ),
    )
    return F.flatten(pieces)


class Plan:
    """How a document is cut: what ``embedded`` does to each row, as data."""

    def __init__(self, configs: Sequence[ChunkConfig], max_length: int = 512, overlap_sents: int = 0, prechunk: bool = True, prechunk_overlap: float | int = 0.5, split: bool = True, keep_tail: bool = False, exclude_specials: bool = True, count_specials: bool = True, deduplicate: str | None = "average", prompt: str | None = None, budget: int = 16384, lead: np.ndarray | None = None, ends: tuple[int | None, int | None] | None = None, pad: int = 0):
        self.configs, self.max_length, self.overlap_sents = list(configs), max_length, overlap_sents
        self.prechunk, self.prechunk_overlap, self.split, self.keep_tail = prechunk, prechunk_overlap, split, keep_tail
        self.exclude_specials, self.count_specials = exclude_specials, count_specials
        self.deduplicate = deduplicate if prechunk else None
        self.budget = budget
        self.lead = lead if lead is not None else np.array([hash_token(m[0].lower()) for m in tx._PY_TOKEN.finditer(prompt or "")], dtype=np.int64)
        self.ends, self.pad = (hash_token(CLS), hash_token(SEP)) if ends is None else ends, pad
        self.room = max_length - sum(x is not None for x in self.ends) - len(self.lead)
        if self.room < 1:
            raise ValueError("max_length leaves no room beside the special tokens and the prompt")
        for c in self.configs:
            if c.max_sents is not None and c.max_tokens is None and overlap_sents >= c.max_sents:
                raise ValueError("chunk_overlap_sents must be below max_chunk_sents")

    def rows(self, counts: list[int]) -> list[tuple]:
        """Chunks of a document, as tuples in the order of ``PLAN``, and the token range of their sequence."""
        us = layout.units(counts, self.room if self.prechunk else None)
        if self.prechunk:
            seqs = layout.sequences([u.n for u in us], self.room, self.prechunk_overlap)
        else:
            seqs = self._cut(us)
        out = []
        before = [0]
        for n in counts:
            before.append(before[-1] + n)
        number = [0] * len(self.configs)
        for k, (a, b) in enumerate(seqs):
            own = us[a : b + 1]
            lo, hi = own[0].lo, own[-1].lo + own[-1].n
            for c, cfg in enumerate(self.configs):
                found = self._chunks(own, cfg)
                for j, (first, last, tlo, n, split) in enumerate(found):
                    whole = {u.sent for u in own[first : last + 1]}
                    out.append((c, number[c], k, own[first].sent, own[last].sent, len(whole), split or own[first].sub > 0 or self._short(own[last], counts), n, tlo, tlo + n, tlo - before[own[first].sent], j == 0, j == len(found) - 1, lo, hi))
                    number[c] += 1
        return out

    def _cut(self, us: list[layout.Unit]) -> list[tuple[int, int]]:
        """A single sequence, cut behind ``room`` tokens."""
        left = self.room
        for i, u in enumerate(us):
            if u.n > left:
                if left:
                    us[i] = u._replace(n=left)
                return [(0, i if left else i - 1)] if left or i else []
            left -= u.n
        return [(0, len(us) - 1)] if us else []

    @staticmethod
    def _short(u: layout.Unit, counts: list[int]) -> bool:
        return u.sub == 0 and u.n < counts[u.sent]

    def _chunks(self, own: list[layout.Unit], cfg: ChunkConfig) -> list[tuple[int, int, int, int, bool]]:
        if cfg.max_tokens is None:
            return [(a, b, own[a].lo, own[b].lo + own[b].n - own[a].lo, False) for a, b in layout.sentence_windows(len(own), cfg.max_sents, self.overlap_sents, keep_tail=self.keep_tail)]
        sizes = [u.n for u in own]
        if self.count_specials and sizes:
            sizes[0] += self.ends[0] is not None and not len(self.lead)
            sizes[-1] += self.ends[1] is not None
        out = []
        for a, b, piece, _ in layout.greedy(sizes, cfg.max_tokens, cfg.max_sents, self.overlap_sents, self.split):
            if piece < 0:
                out.append((a, b, own[a].lo, own[b].lo + own[b].n - own[a].lo, False))
            else:
                at = piece * cfg.max_tokens
                n = min(cfg.max_tokens, own[a].n - at)
                if n > 0:
                    out.append((a, a, own[a].lo + at, n, True))
        return out


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: str = "regex") -> DataFrame:
    """(id, sents, hashes, counts): sentence texts, the hashes of all tokens and how many each sentence has.

    The default segmenter runs in the JVM; others are Arrow functions.
    """
    t = F.col(text_col)
    sents = tx.sentence_texts(t) if method == "regex" else F.transform(tx.segment(t, method), lambda s: s["text"])
    base = docs.select(F.col(id_col), sents.alias("sents"))
    toks = base.select(id_col, "sents", F.transform("sents", tx.words).alias("toks"))
    return toks.select(id_col, "sents", F.transform(F.flatten("toks"), token_hash).alias("hashes"), F.transform("toks", F.size).alias("counts"))


def prepared_by(tokenizer: VocabularyTokenizer, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: str = "regex") -> DataFrame:
    """(id, text, sents, hashes, counts, starts, ends): as ``prepared``, with the ids of a vocabulary and the places of tokens.

    All tokens of a text with a sentence are kept: one between two sentences belongs to the earlier, one before the first to the first.
    """
    fields = {"sents": "array<string>", "hashes": "array<bigint>", "counts": "array<int>", "starts": "array<int>", "ends": "array<int>"}

    @sliced("struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">", 1)
    def run(texts: pa.Array) -> pa.Array:
        every = [t or "" for t in texts.to_pylist()]
        spans = tx.sentence_offsets(every, method)
        ids, places, sizes = tokenizer([t if s else "" for t, s in zip(every, spans)])
        tokenizer.check(ids)
        base, counts = 0, []
        for s, n in zip(spans, sizes.tolist()):
            cuts = np.maximum.accumulate(np.searchsorted(places[base : base + n, 1], [a for a, _ in s], side="right")) if s else np.zeros(0, dtype=np.int64)
            cuts[:1] = 0
            counts.append(np.diff(np.append(cuts, n)) if s else cuts)
            base += n
        list_of = lambda v, n, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(v, kind))
        n_sents = [len(s) for s in spans]
        columns = [
            list_of([t[a:b] for t, s in zip(every, spans) for a, b in s], n_sents, pa.string()), list_of(ids, sizes, pa.int64()),
            list_of(np.concatenate(counts) if counts else [], n_sents, pa.int32()), list_of(places[:, 0], sizes, pa.int32()), list_of(places[:, 1], sizes, pa.int32()),
        ]
        return pa.StructArray.from_arrays(columns, names=list(fields))

    return docs.select(F.col(id_col), F.col(text_col).alias("__text"), run(F.col(text_col)).alias("p")).select(id_col, "__text", "p.*")


def embedded(docs: DataFrame, plan: Plan, options: Options, encoder: TokenEncoder | None = None, id_col: str = "doc_id", text_col: str = "text", method: str = "regex", tokenizer: VocabularyTokenizer | None = None) -> DataFrame:
    """(id, __text, sents, __chunk): a row for each chunk with the fields of ``PLAN``, ``PLACES`` and ``embedding``.

    Vectors are post-processed sequence by sequence, so that the mean of a chunk that two sequences have may be shorter than they are.

    ``__text`` is there only with a tokenizer.
    """
    enc = batched(encoder or HashContextEncoder(options.dim, options.context))
    dims = min(enc.dim, options.truncate_dims or enc.dim)
    item = [*_PLAN_TYPE, pa.field("char_lo", pa.int32()), pa.field("char_hi", pa.int32()), pa.field("embedding", pa.list_(pa.float64()))]
    lead = plan.lead
    names = [f.name for f in _PLAN_TYPE]

    of_slice = (_OF_TOKEN, _OF_COUNT * len(plan.configs), *([0, 0] if tokenizer else []))

    @sliced(f"array<struct<{(PLAN + ', ' + PLACES).replace(' ', ': ').replace(',:', ',')}, embedding: array<double>>>", *of_slice)
    def run(hashes: pa.Array, counts: pa.Array, *places: pa.Array) -> pa.Array:
        flat, base = _flat(hashes)
        rows, sizes = [], []
        for c in counts.to_pylist():
            own = plan.rows(c or [])
            rows += own
            sizes.append(len(own))
        table = np.array(rows, dtype=np.int64).reshape(-1, len(names) + 2)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        col = {n: table[:, k] for k, n in enumerate(names)}
        # Rows of a sequence stand together.
        new = np.ones(len(table), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (col["seq_no"][1:] != col["seq_no"][:-1])
        begin = np.flatnonzero(new)
        behind = np.append(begin, len(table))[1:]
        lo, hi = (table[begin, k] + base[doc[begin]] for k in (-2, -1))
        mean = np.zeros((len(table), dims))

        def pool(own, first, vectors, cls, sep, context):
            n = (behind - begin)[own]
            of = np.repeat(np.arange(len(own)), n)
            r = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
            shift = (first - table[begin[own], -2])[of]
            a, z = col["tok_lo"][r] + shift, col["tok_hi"][r] + shift
            padded = np.concatenate([vectors[:, :dims], np.zeros((1, dims))])
            total = np.add.reduceat(padded, np.stack([a, z], axis=1).ravel(), axis=0)[::2]
            total[a == z] = 0
            size = z - a
            if not plan.exclude_specials:
                opens, closes = col["opens"][r].astype(bool) & (not len(lead)), col["closes"][r].astype(bool)
                if cls is not None:
                    total, size = total + np.where(opens[:, None], cls[of, :dims], 0), size + opens
                if sep is not None:
                    total, size = total + np.where(closes[:, None], sep[of, :dims], 0), size + closes
            value = total / np.maximum(size, 1)[:, None] + (0 if context is None else context[of, :dims])
            mean[r] = np.where(size[:, None] > 0, value, 0)

        run_batches(enc, flat, lo, hi, lead, plan.ends, plan.pad, plan.budget, pool)
        mean = finished(mean, options)
        keep = np.arange(len(table))
        if plan.deduplicate:
            keep, mean, col["chunk_no"] = _deduplicated(doc, col, mean, plan.deduplicate)
            sizes = np.bincount(doc[keep], minlength=len(sizes))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * dims, pa.int32()), pa.array(mean.ravel(), pa.float64()))
        values = [col[n] if n == "chunk_no" and plan.deduplicate else col[n][keep] for n in names]
        chars = [np.full(len(keep), -1)] * 2
        if places and len(keep):
            a, z = (col[n][keep] + base[doc[keep]] for n in ("tok_lo", "tok_hi"))
            starts, stops = (_flat(x)[0] for x in places)
            chars = [np.where(z > a, np.append(starts, 0)[a], -1), np.where(z > a, stops[z - 1] if len(stops) else 0, -1)]
        values += chars
        out = pa.StructArray.from_arrays([*(pa.array(v.astype(bool) if f.type == pa.bool_() else v, f.type) for v, f in zip(values, item)), lists], fields=item)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), out)

    if tokenizer is None:
        return prepared(docs, id_col, text_col, method).select(id_col, "sents", F.explode(run("hashes", "counts")).alias("__chunk"))
    return prepared_by(tokenizer, docs, id_col, text_col, method).select(id_col, "__text", "sents", F.explode(run("hashes", "counts", "starts", "ends")).alias("__chunk"))


def finished(vectors: np.ndarray, options: Options) -> np.ndarray:
    """Half precision first, then unit length; the same as ``vectors.postprocessed``."""
    if options.half:
        with np.errstate(over="ignore"):
            vectors = vectors.astype(np.float16).astype(np.float64)
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-12)[:, None] if options.normalize else vectors


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and where each row's begin; null rows have none."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    return lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size


def _deduplicated(doc: np.ndarray, col: dict[str, np.ndarray], mean: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, vectors, numbers): one row for each document, configuration and token range, with the mean vector or the first; numbered by place."""
    if how not in ("average", "first"):
        raise ValueError(f"Invalid method: {how!r}")
    keys = (doc, *(col[n] for n in ("config_no", "first_sent", "last_sent", "tok_lo", "tok_hi")))
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, mean, order
    differs = lambda ks: np.append(True, np.any([k[order][1:] != k[order][:-1] for k in ks], axis=0))
    at = np.flatnonzero(differs(keys))
    first = np.minimum.reduceat(order, at)  # rows are in the order of sequences
    if how == "average":
        vectors = np.add.reduceat(mean[order], at, axis=0) / np.diff(np.append(at, len(order)))[:, None]
    else:
        vectors = mean[first]
    part = np.flatnonzero(differs(keys[:2])[at])
    return first, vectors, np.arange(len(at)) - np.repeat(part, np.diff(np.append(part, len(at))))


def chunk_text(sents: Column, chunk: Column, text: Column | None = None) -> Column:
    """The chunk's sentences joined by blanks; a part of a sentence is cut at its tokens, by their places in the text if these are known."""
    whole = F.array_join(F.slice(sents, chunk["first_sent"] + 1, chunk["last_sent"] - chunk["first_sent"] + 1), " ")
    if text is not None:
        part = F.trim(F.substring(text, chunk["char_lo"] + 1, chunk["char_hi"] - chunk["char_lo"]))
    else:
        pieces = F.regexp_extract_all(whole, F.lit(tx.TOKEN + r"[^\p{L}\p{N}]*"), F.lit(0))
        part = F.rtrim(F.array_join(F.slice(pieces, chunk["sent_lo"] + 1, F.greatest(chunk["n_tokens"], F.lit(0))), ""))
    return F.when(chunk["is_split"], part).otherwise(whole)


def deduplicate(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str = "embedding", method: str = "average") -> DataFrame:
    """One row for each key: the mean of the vectors, or the first's, in the given order; other columns are the first row's.

    A grouping shuffle with partial aggregation; vectors are summed by position in the JVM.
    """
    if method not in ("average", "first"):
        raise ValueError(f"Invalid method: {method!r}")
    rest = [c for c in chunks.columns if c not in keys]
    first = chunks.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    if method == "first":
        return first.select(*keys, "row.*")
    dims = chunks.select(*keys, F.posexplode(vector).alias("dim", "value")).groupBy(*keys, "dim").agg(F.avg("value").alias("value"))
    means = dims.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("m")).select(*keys, F.transform("m", lambda x: x["value"]).alias("mean"))
    both = first.alias("f").join(means.alias("m"), [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    return both.select(*(F.col(f"f.{k}") for k in keys), *((F.coalesce(F.col("m.mean"), F.col(f"f.row.{c}")).alias(c) if c == vector else F.col(f"f.row.{c}").alias(c)) for c in rest))
