"""Options and plan-time checks.  Everything here fails before a job starts."""

from __future__ import annotations

import contextlib
import logging
import math
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

log = logging.getLogger("chunkloom")
SEGMENTERS = ("regex", "regex-abbrev", "blingfire", "nltk", "pysbd", "syntok")
FRAMES = ("spark", "pandas", "arrow")


@dataclass(frozen=True)
class ChunkConfig:
    """Limits of one kind of chunk; one of both at least."""

    max_sents: int | None = 1
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        if self.max_sents is None and self.max_tokens is None:
            raise ValueError("a chunk needs max_chunk_sents or max_chunk_tokens")
        for name, v in (("max_chunk_sents", self.max_sents), ("max_chunk_tokens", self.max_tokens)):
            positive_int(name, v)


@dataclass(frozen=True)
class Options:
    """How vectors are made and treated afterwards.

    ``normalize`` brings every sequence's vectors to unit length; ``renormalize`` also what is averaged from several sequences.
    """

    dim: int = 8
    context: float = 0.5
    normalize: bool = False
    half: bool = False
    truncate_dims: int | None = None
    renormalize: bool = False
    document_prompt: str | None = None
    query_prompt: str | None = None

    def __post_init__(self) -> None:
        positive_int("dim", self.dim)
        positive_int("truncate_dims", self.truncate_dims)


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def positive_int(name: str, v: int | None) -> None:
    if v is None:
        return
    if not _whole(v):
        raise TypeError(f"{name} must be a whole number or None")
    if v < 1:
        raise ValueError(f"{name} must be at least 1")


def overlap_sents(v: int) -> None:
    if not _whole(v) or v < 0:
        raise TypeError("chunk_overlap_sents must be a whole number, 0 at least")


def prechunk_overlap(v: float | int) -> None:
    if isinstance(v, float):
        if not 0 <= v < 1:
            raise ValueError("prechunk_overlap as a fraction must be in [0, 1)")
    elif not _whole(v) or v < 0:
        raise ValueError("prechunk_overlap must be a fraction in [0, 1) or a whole number of sentences")


def member(name: str, v: str, allowed: Sequence[str]) -> None:
    if v not in allowed:
        raise ValueError(f"Invalid {name}: {v!r}; one of {', '.join(allowed)}")


def documents(df: DataFrame, id_col: str, text_col: str) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("documents must be a DataFrame")
    for c in (id_col, text_col):
        if c not in df.columns:
            raise ValueError(f"documents have no column {c!r}")
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        raise TypeError(f"{text_col!r} must be a string column")


def configs(sents: int | None | Sequence[int | None], tokens: int | None | Sequence[int | None], max_length: int | None = None) -> list[ChunkConfig]:
    """Aligned pairs: a single value goes with every value of a list; two lists must be equally long."""
    many = [list(v) if isinstance(v, (list, tuple)) else None for v in (sents, tokens)]
    for name, v in zip(("max_chunk_sents", "max_chunk_tokens"), many):
        if v is not None and not v:
            raise ValueError(f"{name} must not be empty")
    n = max((len(v) for v in many if v is not None), default=1)
    if any(v is not None and len(v) != n for v in many):
        raise ValueError("lists of max_chunk_sents and max_chunk_tokens must be equally long")
    a, b = ([one] * n if v is None else v for v, one in zip(many, (sents, tokens)))
    out = [ChunkConfig(x, y) for x, y in zip(a, b)]
    for c in out:
        if max_length is not None and c.max_tokens is not None and c.max_tokens > max_length:
            raise ValueError("max_chunk_tokens exceeds max_length")
    return out


def overlap_count(overlap: float | int | Sequence[int] | dict[int, int], length: int, at: int | None = None) -> int:
    """How many of ``length`` items are shared: a fraction is rounded up but never all; a list goes by position, a dict by length."""
    if isinstance(overlap, float):
        if not 0 <= overlap < 1:
            raise ValueError("an overlap as a fraction must be in [0, 1)")
        n = math.ceil(length * overlap)
        return n - 1 if n == length else n
    if isinstance(overlap, (list, tuple)):
        if at is None:
            raise ValueError("an overlap list needs a position")
        return overlap[at]
    if isinstance(overlap, dict):
        return overlap[length]
    if _whole(overlap):
        if not 0 <= overlap < length:
            raise ValueError("an overlap must be in [0, length)")
        return overlap
    raise ValueError("an overlap must be a number, a list or a dict")


def num_jobs(n: int | None) -> int:
    """None or 0 is 1; negative numbers count back from all CPUs; more than there are is cut with a warning."""
    cpus = os.cpu_count() or 1
    if not n:
        return 1
    if n < 0:
        return max(1, cpus + 1 + n)
    if n > cpus:
        log.warning("%d jobs asked for, %d CPUs present", n, cpus)
    return min(n, cpus)


def configure_logging(level: int | str = logging.INFO, stream: bool = True, file: str | None = None) -> logging.Logger:
    """Handlers for this package's logger; earlier ones are replaced."""
    log.handlers.clear()
    for h in [*([logging.StreamHandler()] if stream else []), *([logging.FileHandler(file)] if file else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)
    return log


@contextlib.contextmanager
def timer(what: str, readout: str = "%s took %.3f s") -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info(readout, what, time.perf_counter() - began)
