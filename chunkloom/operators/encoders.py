"""Token encoders.  An encoder gets padded batches of token ids and returns a vector for each token in context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.functions import layout


class TokenEncoder(Protocol):
    """A model.  ``max_length``, where there is one, is the longest sequence it takes, special tokens included."""

    dim: int

    def encode(self, input_ids: np.ndarray, attention_mask: np.ndarray, special_tokens_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """For (n, width) ids: the (n, width, dim) vectors of tokens, of any kind of float, and (n, dim) to add to every pooled vector of a
        sequence, or None where the vectors have their context in them.  Vectors under a zero of ``attention_mask`` aren't read."""


class HashContextEncoder:
    """A stand-in without learned meaning: coordinate i of a token is nibble i of its id less 7.5, and the context adds
    ``weight`` times the mean of the sequence without special tokens, so that the same sentence embeds differently in different documents.

    Coordinates are multiples of a half, so sums are exact and results depend neither on partitioning nor on batches.
    """

    def __init__(self, dim: int = 8, weight: float = 0.5):
        if not 1 <= dim <= 8:
            raise ValueError("dim must be in 1..8")
        self.dim, self.weight = dim, weight

    def encode(self, input_ids: np.ndarray, attention_mask: np.ndarray, special_tokens_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        v = ((input_ids[..., None] >> (4 * np.arange(self.dim))) & 15) - 7.5
        if not self.weight:
            return v, None
        own = attention_mask & ~special_tokens_mask
        return v, self.weight * (np.einsum("nwd,nw->nd", v, own.astype(np.float64)) / np.maximum(own.sum(axis=1), 1)[:, None])


class _OneByOne:
    """An encoder with ``tokens(ids)`` and ``context(vectors)`` for one sequence at a time, as a batch encoder."""

    def __init__(self, encoder):
        self.encoder, self.dim, self.max_length = encoder, encoder.dim, getattr(encoder, "max_length", None)

    def encode(self, input_ids, attention_mask, special_tokens_mask):
        out, contexts = np.zeros((*input_ids.shape, self.dim)), []
        for k, (ids, mask, special) in enumerate(zip(input_ids, attention_mask, special_tokens_mask)):
            own = mask & ~special
            out[k, own] = v = self.encoder.tokens(ids[own])
            if (mask & special).any():
                out[k, mask & special] = self.encoder.tokens(ids[mask & special])
            contexts.append(self.encoder.context(v))
        return out, None if any(c is None for c in contexts) else np.array(contexts).reshape(len(input_ids), self.dim)


def batched(encoder) -> TokenEncoder:
    return encoder if hasattr(encoder, "encode") else _OneByOne(encoder)


def run_batches(
    encoder: TokenEncoder, flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, lead: np.ndarray, ends: tuple[int | None, int | None], pad: int, budget: int,
    use: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None], None],
) -> None:
    """Encodes the sequences flat[lo:hi], longest first, in padded batches of at most ``budget`` tokens, and hands on each batch.

    A sequence is the first of ``ends``, the prompt's tokens ``lead``, its own tokens and the second of ``ends``; None leaves an end out.
    ``use`` gets the sequences' numbers, where each one's own tokens begin among the batch's, these tokens' vectors one after another,
    the vectors of both ends and the context.
    """
    before, after = int(ends[0] is not None), int(ends[1] is not None)
    skip = before + len(lead)
    size = hi - lo + skip + after
    order = np.argsort(-size, kind="stable")
    number = np.array(layout.token_batches(size[order].tolist(), budget), dtype=np.int64)
    for own in np.split(order, np.flatnonzero(np.diff(number)) + 1) if len(order) else []:
        n, at = size[own], np.arange(layout.power_of_two(int(size[own[0]])))
        mask = at < n[:, None]
        special = np.zeros(mask.shape, dtype=bool)
        inner = (at >= skip) & (at < (n - after)[:, None])
        ids = np.full(mask.shape, pad, dtype=np.int64)
        count = (hi - lo)[own]
        first = np.cumsum(count) - count
        ids[inner] = flat[np.repeat(lo[own] - first, count) + np.arange(count.sum())]
        ids[:, before:skip] = lead
        if before:
            ids[:, 0], special[:, 0] = ends[0], True
        if after:
            ids[np.arange(len(own)), n - 1], special[np.arange(len(own)), n - 1] = ends[1], True
        v, context = encoder.encode(ids, mask, special)
        use(own, first, v[inner], v[:, 0] if before else None, v[np.arange(len(own)), n - 1] if after else None, context)


def hash_token(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def token_hash(token: Column) -> Column:
    """The first 32 bits of a token's MD5, as a number; the same as ``hash_token``."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
