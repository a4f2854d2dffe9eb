"""Where sequences and chunks begin and end, from numbers of tokens a sentence alone.

Plain functions over small lists; the operators run them inside Arrow batches.  All are linear in the number of sentences and chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from chunkloom.config import overlap_count


class Unit(NamedTuple):
    """A sentence, or a piece of one that exceeds the sequence length."""

    sent: int
    sub: int
    lo: int
    n: int


class Chunk(NamedTuple):
    first: int  # positions of units, both ends included
    last: int
    lo: int  # token range
    hi: int
    split: int  # number of the piece of a long unit, -1 for whole ones


def split_ids(ids: Sequence[int], length: int) -> list[int]:
    """Sentence numbers of tokens after long sentences were cut every ``length`` tokens; -1 belongs to no sentence."""
    out, last, seen, number = [], None, 0, -1
    for i in ids:
        if i == -1:
            out.append(-1)
            continue
        if i != last:
            last, seen, number = i, 0, number + 1
        elif seen and seen % length == 0:
            number += 1
        seen += 1
        out.append(number)
    return out


def units(counts: Sequence[int], length: int | None) -> list[Unit]:
    """Sentences as units of at most ``length`` tokens; a sentence without tokens is a unit of its own."""
    out, lo = [], 0
    for s, n in enumerate(counts):
        if length is None or n <= length:
            out.append(Unit(s, 0, lo, n))
        else:
            out += [Unit(s, p, lo + p * length, min(length, n - p * length)) for p in range(-(-n // length))]
        lo += n
    return out


def sequences(sizes: Sequence[int], room: int, overlap: float | int) -> list[tuple[int, int]]:
    """Greedy runs (first, last) of units that fit into ``room`` tokens.

    The next run repeats the last ``floor(n * overlap)`` units of the n before it (a whole number: so many, fewer than all),
    less what doesn't leave room for its first new unit.
    """
    out: list[tuple[int, int]] = []
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > room:
            out.append((first, i - 1))
            had = i - first
            keep = math.floor(had * overlap) if isinstance(overlap, float) else min(overlap, had - 1)
            start = i - keep
            total -= sum(sizes[first:start])
            while start < i and total + n > room:
                total -= sizes[start]
                start += 1
            first = start
        total += n
    if sizes:
        out.append((first, len(sizes) - 1))
    return out


def sentence_windows(n: int, size: int, overlap: float | int | Sequence[int], at: int | None = None, keep_tail: bool = False) -> list[tuple[int, int]]:
    """Sliding windows (first, last) over n sentences; a tail that fills no window is left out unless ``keep_tail``."""
    step = size - overlap_count(overlap, size, at)
    have = min(size, n)
    if n < 1:
        return []
    out = [(s, s + have - 1) for s in range(0, n - have + 1, step)]
    if keep_tail and out[-1][1] < n - 1:
        out.append((out[-1][0] + step, n - 1))
    return out


def greedy(counts: Sequence[int], most: int, sents: int | None = None, overlap: int = 0, split: bool = True) -> list[tuple[int, int, int, int]]:
    """Chunks (first, last, piece, tokens) of at most ``most`` tokens and ``sents`` sentences.

    A new chunk starts with the last ``overlap`` sentences of the one before, even where that exceeds a limit.  A sentence beyond the limit is
    cut into pieces (piece 0, 1, ...) or kept whole; pieces are chunks of their own and are followed by no overlap.  Piece is -1 for whole sentences.
    """
    out: list[tuple[int, int, int, int]] = []
    first, held, total = 0, 0, 0
    for i, n in enumerate(counts):
        if total + n <= most and (sents is None or held < sents):
            if not held:
                first = i
            held, total = held + 1, total + n
            continue
        keep = 0
        if held:
            out.append((first, first + held - 1, -1, total))
            keep = min(overlap, held)
        if n > most and split:
            out += [(i, i, p, min(most, n - p * most)) for p in range(-(-n // most))]
            held = total = 0
        elif n > most:
            first, held, total = i, 1, n
        else:
            first, held = i - keep, keep + 1
            total = sum(counts[first : i + 1])
    if held:
        out.append((first, first + held - 1, -1, total))
    return out


def power_of_two(x: int) -> int:
    """The least power of two that isn't below x."""
    return 1 << max(0, int(x) - 1).bit_length()


def token_batches(sizes: Sequence[int], budget: int) -> list[int]:
    """A batch number for each item, in the given order: a batch's items times its longest, rounded up to a power of two, stay within
    the budget; an item beyond it is a batch of its own."""
    out, number, n, longest = [], 0, 0, 0
    for s in sizes:
        if n and (n + 1) * power_of_two(max(longest, s)) > budget:
            number, n, longest = number + 1, 0, 0
        out.append(number)
        n, longest = n + 1, max(longest, s)
    return out


def pad(rows: Sequence[Sequence[int]], value: int, strategy: str | None = "longest", max_length: int | None = None) -> list[list[int]]:
    """Rows filled up to the longest, or to ``max_length``, or as they are."""
    if strategy is None:
        return [list(r) for r in rows]
    if strategy not in ("longest", "max_length"):
        raise ValueError(f"Invalid padding strategy: {strategy!r}")
    if strategy == "max_length" and max_length is None:
        raise ValueError("max_length is required for this padding strategy")
    n = max_length if strategy == "max_length" else max((len(r) for r in rows), default=0)
    if any(len(r) > n for r in rows):
        raise ValueError("a row is longer than max_length")
    return [[*r, *[value] * (n - len(r))] for r in rows]


def collate(rows: Sequence[Sequence[int]], pad_id: int = 0, standardize: bool = True) -> dict[str, list[list[int]]]:
    """A padded batch with its attention mask; its width is rounded up to a power of two unless ``standardize`` is off."""
    if not rows:
        return {}
    n = max(map(len, rows))
    ids = pad(rows, pad_id, "max_length", power_of_two(n) if standardize else n)
    return {"input_ids": ids, "attention_mask": [[int(x != pad_id) for x in r] for r in ids]}
