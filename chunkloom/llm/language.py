"""Language identification by cross-parsing entropy.

Labelled text of each language makes a suffix automaton.  A text is parsed greedily into the longest
phrases that occur in that language's sample; ``phrases * log2(sample length) / length`` estimates
the bits a symbol that the language needs for the text, and the language with the fewest wins.

Text is lower-cased and read as bytes; all but letters becomes one blank, and blanks in a row count
as one.  A batch's texts are parsed side by side: a step advances all of them by a symbol in all languages at once, by one
table look-up each.  A long text is cut into blocks that are first parsed each on its own; then every block is entered in the state that the block
before it ends in, and followed until a phrase begins where one begins in its own parse as well, from where on the two parses are the
same.  So the number of phrases is that of the whole text's parse, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import columns, slices, text_arrays

#: The labelled sample: so many texts a language at most, and so many symbols of them.
SAMPLE_TEXTS, SAMPLE_SYMBOLS = 64, 16384
#: A text for which every language needs more bits a symbol is rejected.  Text of the four labelled languages stays below 6.4 here, text of random letters needs 9 or more.
MOST_BITS = 7.0
#: Symbols of a long text that are parsed at once.
BLOCK = 2048
#: Bytes of the table that every worker holds.
MOST_TABLE = 1 << 28
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, letters of each text) after lower-casing, blanking and joining blanks."""
    data, off = text_arrays(pc.utf8_lower(column))
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = off[:-1][off[:-1] < len(data)]
    keep[starts] = letter[starts]  # no blank at the start of a text
    run = np.append(0, np.cumsum(keep))
    count = np.append(0, np.cumsum(letter))
    return np.where(letter, data, 32)[keep].astype(np.uint8), run[off], np.diff(count[off])


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of the text; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p != -1:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return move


class Model:
    """Automata of all languages as one table: entry = (row of the next state) * 2 + (a phrase begins)."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.log_size = np.array([math.log2(max(2, len(samples[n]))) for n in self.names])
        seen = sorted({c for s in samples.values() for c in s})
        self.code = np.zeros(256, dtype=np.int32)  # 0: in no sample
        for i, c in enumerate(seen):
            self.code[c] = i + 1
        self.width = len(seen) + 1
        self.roots: list[int] = []
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        base = 0
        for n in self.names:
            move = suffix_automaton(samples[n])
            arcs = np.array([(base + s, self.code[c], base + t) for s, m in enumerate(move) for c, t in m.items()], dtype=np.int32).reshape(-1, 3)
            self.roots.append(base)
            self.arcs.append(tuple(arcs.T))
            base += len(move)
        self.states = base
        if self.states * self.width * 4 > MOST_TABLE:
            raise ValueError(f"{len(self.names)} languages of {self.width - 1} symbols need too large a table; label fewer languages or lower sample_symbols")
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def ready(self) -> np.ndarray:
        if self.table is None:
            table = np.empty((self.states, self.width), dtype=np.int32)
            ends = [*self.roots[1:], self.states]
            for root, end, (src, code, dst) in zip(self.roots, ends, self.arcs):
                again = np.full(self.width, root, dtype=np.int32)
                at_root = src == root
                again[code[at_root]] = dst[at_root]
                table[root:end] = again * self.width * 2 + 1
                inner = ~at_root
                table[src[inner], code[inner]] = dst[inner] * self.width * 2
            self.table = table.ravel()
        return self.table

    def phrases(self, data: np.ndarray, off: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """(languages, texts): phrases of each text's parse by each language."""
        table, texts = self.ready(), len(off) - 1
        size = np.diff(off)
        blocks = -(-size // block)
        text = np.repeat(np.arange(texts), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[:-1][text] + nth * block
        length = np.minimum(block, off[1:][text] - start)
        order = np.argsort(-length, kind="stable")
        first, code = start[order], self.code[data]
        several = bool(len(nth) and nth.max())
        begins = np.zeros((len(self.names), len(data) if several else 0), dtype=bool)
        active = np.searchsorted(-length[order], -np.arange(block), side="left")
        state = np.repeat((np.array(self.roots, dtype=np.int32) * self.width)[:, None], len(text), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        for t in range(int(length[order[0]]) if len(length) else 0):
            n = active[t]
            at = first[:n] + t
            v = table.take(state[:, :n] + code[at])
            new = v & 1
            count[:, :n] += new
            if several:
                begins[:, at] = new
            np.right_shift(v, 1, out=state[:, :n])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        state, count = state[:, back], count[:, back]
        if several:
            self._entered(table, code, begins, text, nth, start, length, state, count)
        out = np.zeros((len(self.names), texts))
        for k in range(len(self.names)):
            out[k] = np.bincount(text, count[k], minlength=texts)
        return out

    @staticmethod
    def _entered(table: np.ndarray, code: np.ndarray, begins: np.ndarray, text: np.ndarray, nth: np.ndarray, start: np.ndarray, length: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
        """Corrects the blocks' counts for the state that they are entered in; ``end`` and ``count`` are each block's, from its own parse."""
        alone, own_end = count.copy(), end.copy()
        later = np.flatnonzero(nth > 0)
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(end)), later, indexing="ij"))
        while len(lane):
            now = end[lang, lane - 1]
            true, own = np.zeros(len(lane), dtype=np.int32), np.zeros(len(lane), dtype=np.int32)
            result, after = alone[lang, lane], own_end[lang, lane]
            open_ = np.arange(len(lane))
            t = 0
            while len(open_):
                k, at = lang[open_], start[lane[open_]] + t
                v = table[now + code[at]]
                new, there = (v & 1).astype(bool), begins[k, at]
                true += new
                own += there
                now = v >> 1
                met, over = new & there, length[lane[open_]] == t + 1
                result[open_[met]] += true[met] - own[met]
                lost = over & ~met
                result[open_[lost]], after[open_[lost]] = true[lost], now[lost]
                on = ~(met | over)
                open_, now, true, own = open_[on], now[on], true[on], own[on]
                t += 1
            changed = after != end[lang, lane]
            count[lang, lane], end[lang, lane] = result, after
            # A block that never met its own parse ends in another state than the next one was entered in.
            follows = changed & (lane + 1 < len(text))
            follows[follows] = text[lane[follows] + 1] == text[lane[follows]]
            lang, lane = lang[follows], lane[follows] + 1

    def judge(self, column: pa.Array, most_bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, its bits a symbol, how many more the next language needs) of each text."""
        n = len(column)
        lang, bits, margin = np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
        if not self.names:
            return lang, bits, margin
        for lo, hi in slices(column):
            data, off, letters = symbols(column.slice(lo, hi - lo))
            score = self.phrases(data, off) * self.log_size[:, None] / np.maximum(np.diff(off), 1)
            best = score.argmin(axis=0)
            least = score[best, np.arange(hi - lo)]
            some = letters > 0
            bits[lo:hi] = np.where(some, least, np.nan)
            if len(self.names) > 1:
                margin[lo:hi] = np.where(some, np.sort(score, axis=0)[1] - least, np.nan)
            lang[lo:hi] = np.where(some & (least <= most_bits), best, -1)
        return lang, bits, margin


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_symbols: int = SAMPLE_SYMBOLS) -> Model:
    """A model from a bounded sample: of each language the ``sample_texts`` distinct texts with the least
    hashes, and of them, joined by blanks, the first ``sample_symbols`` symbols.  Rows with a null label or
    text don't count; no labelled rows give a model that rejects everything."""
    t = columns(labelled, text_col, lang_col).toDF("text", "lang").where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    least = t.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_texts).select("lang", "h")
    # Their number is bounded by sample_texts a language, and Model refuses more languages than a worker can hold.
    least = F.broadcast(t.sparkSession.createDataFrame(least.collect(), "lang string, h bigint"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                data, off, _ = symbols(b.column(2).slice(lo, hi - lo))
                own = [data[x : min(y, x + sample_symbols + 2)].tobytes().strip()[:sample_symbols] for x, y in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(own, pa.binary())], ["lang", "h", "sample"])

    # At most sample_texts * sample_symbols bytes a language reach the driver, whatever the texts' length.
    chosen = t.join(least, ["lang", "h"]).select("lang", "h", "text").mapInArrow(cut, "lang string, h bigint, sample binary").distinct()
    samples: dict[str, bytes] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h, bytes(r.sample))):
        own = samples.get(r.lang, b"")
        if len(own) < sample_symbols:
            more = bytes(r.sample)
            samples[r.lang] = (own + b" " + more if own else more)[:sample_symbols]
    return Model({k: v for k, v in samples.items() if v})


def identified(docs: DataFrame, model: Model, most_bits: float = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, bits, margin, accepted) for each row.

    ``language`` is null and ``accepted`` false for texts that are null, have no letters or need more than
    ``most_bits`` in every language; bits is null without letters.  Ties go to the language first in
    alphabetical order.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.names, None], type=pa.string())
        for b in batches:
            lang, bits, margin = m.judge(b.column(1), most_bits)
            out = [b.column(0), names.take(pa.array(np.where(lang < 0, len(m.names), lang))), pa.array(np.round(bits, 6), from_pandas=True), pa.array(np.round(margin, 6), from_pandas=True), pa.array(lang >= 0)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "language", "bits", "margin", "accepted"])

    return columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, language string, bits double, margin double, accepted boolean")


def accepted(docs: DataFrame, model: Model, most_bits: float = MOST_BITS, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the model's languages; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.judge(b.column(at), most_bits)[0] >= 0))

    return docs.mapInArrow(run, docs.schema)
