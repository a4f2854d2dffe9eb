"""The engine: documents to embedded chunks, queries to vectors, search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom import config
from chunkloom.config import Options
from chunkloom.operators import chunks as ch
from chunkloom.operators import text as tx
from chunkloom.operators import vectors as vx
from chunkloom.operators.encoders import HashContextEncoder, TokenEncoder, batched, run_batches, token_hash
from chunkloom.operators.order import numbered
from chunkloom.operators.slices import sliced
from chunkloom.operators.tokenizer import VocabularyTokenizer


class LateChunker:
    """Embeds whole documents, then pools chunks.

    ``encoder`` is a ``TokenEncoder``; the default one has no learned meaning.  ``tokenizer`` gives the ids of its vocabulary; without one tokens are
    words, with the first 32 bits of their MD5 as ids.
    """

    def __init__(self, options: Options | None = None, encoder: TokenEncoder | None = None, tokenizer: VocabularyTokenizer | None = None):
        self.options = options or Options()
        self.encoder = encoder or HashContextEncoder(self.options.dim, self.options.context)
        self.tokenizer = tokenizer

    def max_length(self, given: int | None = None) -> int:
        """The longest sequence: what is given, else what model and tokenizer allow, else 512; beyond what they allow is an error."""
        limits = [n for n in (getattr(self.encoder, "max_length", None), getattr(self.tokenizer, "max_length", None)) if n is not None]
        if given is None:
            return min(limits, default=512)
        if given > min(limits, default=given):
            raise ValueError(f"max_length {given} exceeds the model's {min(limits)}")
        return given

    def _lead(self, prompt: str | None) -> np.ndarray | None:
        return None if self.tokenizer is None else self.tokenizer([prompt])[0] if prompt else np.zeros(0, dtype=np.int64)

    def encode(
        self, docs: DataFrame, max_length: int | None = None, max_chunk_sents: int | None | Sequence[int | None] = 1, max_chunk_tokens: int | None | Sequence[int | None] = None,
        chunk_overlap_sents: int = 0, prechunk: bool = True, prechunk_overlap: float | int = 0.5, sent_tokenizer: str = "regex", exclude_special_tokens: bool = True,
        deduplicate: bool | str = True, return_frame: str = "spark", return_text: bool = True, prompt: str | None = None, split_long_sents: bool = True, debug: bool = False,
        index: bool = False, keep_tail: bool = False, count_specials: bool = True, max_batch_tokens: int = 16384, id_col: str = "doc_id", text_col: str = "text",
    ):
        """(id, chunk_idx, max_chunk_sents, max_chunk_tokens, num_sents, first_sent, last_sent, is_split, n_tokens[, chunk], embedding).

        Documents with a null, empty or blank text have no chunks.  A prompt is seen by the encoder but not pooled; ``""`` turns the default prompt off.
        ``max_length`` is the model's unless given.  Sequences go to the encoder longest first, in padded batches of at most ``max_batch_tokens`` tokens.
        ``index`` adds a global ``idx``, which sorts all chunks, and is refused on streams.  ``debug`` adds the sequence number and token range.
        """
        config.documents(docs, id_col, text_col)
        config.positive_int("max_length", max_length)
        config.positive_int("max_batch_tokens", max_batch_tokens)
        max_length = self.max_length(max_length)
        config.overlap_sents(chunk_overlap_sents)
        config.prechunk_overlap(prechunk_overlap)
        config.member("sent_tokenizer", sent_tokenizer, config.SEGMENTERS)
        config.member("return_frame", return_frame, config.FRAMES)
        cfgs = config.configs(max_chunk_sents, max_chunk_tokens, max_length)
        if docs.isStreaming and (index or return_frame != "spark"):
            raise ValueError("a stream of chunks has no global order; ask for return_frame='spark' without index")
        how = {True: "average", False: None}.get(deduplicate, deduplicate)
        if how not in ("average", "first", None):
            raise ValueError(f"Invalid method: {how!r}")
        p = self.options.document_prompt if prompt is None else prompt
        plan = ch.Plan(cfgs, max_length, chunk_overlap_sents, prechunk, prechunk_overlap, split_long_sents, keep_tail, exclude_special_tokens, count_specials, how, p or None, max_batch_tokens, self._lead(p), *((self.tokenizer.ends, self.tokenizer.pad) if self.tokenizer else ()))
        rows = ch.embedded(docs, plan, self.options, self.encoder, id_col, text_col, sent_tokenizer, self.tokenizer)
        c = F.col("__chunk")
        limits = F.array(*(F.struct(F.lit(x.max_sents).cast("int").alias("s"), F.lit(x.max_tokens).cast("int").alias("t")) for x in cfgs))
        lim = F.get(limits, c["config_no"])
        cols = [F.col(id_col), c["chunk_no"].alias("chunk_idx"), lim["s"].alias("max_chunk_sents"), lim["t"].alias("max_chunk_tokens"), *(c[n].alias(n) for n in ("num_sents", "first_sent", "last_sent", "is_split", "n_tokens"))]
        if return_text:
            cols.append(ch.chunk_text(F.col("sents"), c, F.col("__text") if self.tokenizer else None).alias("chunk"))
        if debug:
            cols += [c["config_no"].alias("config_no"), c["seq_no"].alias("sequence_idx"), c["tok_lo"].alias("tok_lo"), c["tok_hi"].alias("tok_hi")]
        vector = vx.normalized(c["embedding"]) if self.options.renormalize else c["embedding"]
        out = rows.select(*cols, vector.alias("embedding"))
        if index:
            out = numbered(out, [id_col, "max_chunk_sents", "max_chunk_tokens", "chunk_idx"])
        return out if return_frame == "spark" else out.toPandas() if return_frame == "pandas" else out.toArrow()

    def encode_queries(self, queries: DataFrame, prompt: str | None = None, exclude_special_tokens: bool = True, id_col: str = "query_id", text_col: str = "text", max_length: int | None = None, max_batch_tokens: int = 16384) -> DataFrame:
        """(id, embedding); a query's prompt is pooled with it.  Null queries and those without tokens are zero vectors.

        A query is cut behind ``max_length`` tokens, if that is given or the model or tokenizer has one.
        """
        config.documents(queries, id_col, text_col)
        config.positive_int("max_length", max_length)
        config.positive_int("max_batch_tokens", max_batch_tokens)
        p = self.options.query_prompt if prompt is None else prompt
        enc, opts, tokenizer = batched(self.encoder), self.options, self.tokenizer
        dims = min(enc.dim, opts.truncate_dims or enc.dim)
        ends, pad = (tokenizer.ends, tokenizer.pad) if tokenizer else ((ch.hash_token(ch.CLS), ch.hash_token(ch.SEP)), 0)
        limited = max_length or getattr(enc, "max_length", None) or getattr(tokenizer, "max_length", None)
        room = self.max_length(max_length) - (sum(x is not None for x in ends) if tokenizer else 0) if limited else None

        def vectors(flat: np.ndarray, size: np.ndarray) -> pa.Array:
            base = np.cumsum(size) - size
            out = np.zeros((len(size), dims))

            def pool(own, first, v, cls, sep, context):
                n = size[own]
                total = np.add.reduceat(np.concatenate([v[:, :dims], np.zeros((1, dims))]), np.stack([first, first + n], axis=1).ravel(), axis=0)[::2]
                if not exclude_special_tokens:
                    for x in (cls, sep):
                        if x is not None:
                            total, n = total + x[:, :dims], n + 1
                out[own] = total / n[:, None] + (0 if context is None else context[:, :dims])

            some = np.flatnonzero(size > 0)
            run_batches(enc, flat, base[some], (base + size)[some], np.zeros(0, dtype=np.int64), ends, pad, max_batch_tokens, lambda own, *rest: pool(some[own], *rest))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * dims, pa.int32()), pa.array(out.ravel()))

        if tokenizer is None:

            @sliced("array<double>", 2)
            def run(rows: pa.Array) -> pa.Array:
                return vectors(rows.flatten().to_numpy(zero_copy_only=False), np.asarray(rows.value_lengths().fill_null(0)))

            toks = tx.words(tx.prompted(F.col(text_col), p or None))
            made = run(F.transform(tx.truncated(toks, room, 0) if room else toks, token_hash))
        else:

            @sliced("array<double>", 1)
            def run(texts: pa.Array) -> pa.Array:
                ids, _, size = tokenizer([t or "" for t in texts.to_pylist()])
                tokenizer.check(ids)
                if room is not None:
                    at = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                    ids, size = ids[at < room], np.minimum(size, room)
                return vectors(ids, size)

            made = run(tx.prompted(F.col(text_col), p or None))
        return queries.select(F.col(id_col), vx.postprocessed(made, opts).alias("embedding"))

    def search(self, chunks: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "doc_id") -> DataFrame:
        """(query_id, rank, id, chunk_idx, score) of the k best chunks for each embedded query."""
        return vx.top_k(chunks.select(id_col, "chunk_idx", "embedding"), queries, k, metric)


def to_numpy(frame: DataFrame, vector: str = "embedding") -> np.ndarray:
    """The vectors as a matrix, in the frame's order; all of them must fit into the driver."""
    rows = frame.select(vector).toArrow().column(0).to_pylist()
    return np.array(rows, dtype=np.float32)
