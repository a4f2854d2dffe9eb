"""Sentences, tokens and prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import SEGMENTERS, member
from chunkloom.operators.slices import sliced

_BLANKS = r" \t\r\f\x0B"
#: From the first character that isn't blank up to the closing marks, or up to the last one that isn't blank where a line or the text ends without any.
SENTENCE = rf"[^.!?\n{_BLANKS}](?:[^.!?\n]*[.!?]+|[^.!?\n]*[^.!?\n{_BLANKS}]|)"
TOKEN = r"[\p{L}\p{N}]+"
_PY_SENTENCE, _PY_TOKEN = re.compile(SENTENCE), re.compile(r"[^\W_]+")
_ABBREVIATION = re.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|etc|e\.g|i\.e|No|Fig|al|Inc|Ltd|Co)|\b(?:[A-Z]\.)*[A-Z])\.$")
Offsets = list[tuple[int, int]]


def prompted(text: Column, prompt: str | None) -> Column:
    """The prompt in front of the text; None leaves the text alone."""
    return text if prompt is None else F.concat(F.lit(prompt), text)


def sentence_texts(text: Column) -> Column:
    """The sentences as strings without blanks around them, in the JVM, for when places aren't needed; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case tokens: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _regex(text: str) -> Offsets:
    return [m.span() for m in _PY_SENTENCE.finditer(text)]


def _merged(text: str) -> Offsets:
    """As ``_regex``, but a full stop behind an abbreviation or a single capital ends no sentence, unless the text or line does."""
    out: Offsets = []
    for a, b in _regex(text):
        if out and _ABBREVIATION.search(text[out[-1][0] : out[-1][1]]) and "\n" not in text[out[-1][1] : a] and not (_starts(text[a:b]) and re.search(r"\w{4,}\.$", text[out[-1][0] : out[-1][1]])):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _starts(s: str) -> bool:
    return s[:1].isupper()


def _from_cursor(text: str, sents: list[str]) -> Offsets:
    out, at = [], 0
    for s in sents:
        found = text.find(s, at)
        a = at if found < 0 else found
        out.append((a, a + len(s)))
        at = a + len(s)
    return out


def _need(module: str):
    try:
        return __import__(module)
    except ImportError as e:
        raise ImportError(f"this segmenter needs the package {module}; install it on driver and executors") from e


def _blingfire(text: str) -> Offsets:
    return [tuple(x) for x in _need("blingfire").text_to_sentences_and_offsets(text)[1]]


def _nltk(text: str) -> Offsets:
    _need("nltk")
    from nltk.tokenize.punkt import PunktSentenceTokenizer

    return list(PunktSentenceTokenizer().span_tokenize(text))


def _pysbd(text: str) -> Offsets:
    return _from_cursor(text, _need("pysbd").Segmenter(language="en", clean=False).segment(text))


def _syntok(text: str) -> Offsets:
    _need("syntok")
    from syntok import segmenter

    return [(s[0].offset, s[-1].offset + len(s[-1].value)) for p in segmenter.process(text) for s in p]


_METHODS: dict[str, Callable[[str], Offsets]] = {"regex": _regex, "regex-abbrev": _merged, "blingfire": _blingfire, "nltk": _nltk, "pysbd": _pysbd, "syntok": _syntok}


def sentence_offsets(text: str | list[str], method: str = "regex") -> Offsets | list[Offsets]:
    """[start, end) of each sentence in characters."""
    member("method", method, SEGMENTERS)
    return _METHODS[method](text) if isinstance(text, str) else [_METHODS[method](t) for t in text]


def segment(text: Column, method: str = "regex") -> Column:
    """array<struct<start,end,text>> of sentences; null and empty texts have none."""
    member("method", method, SEGMENTERS)
    cut = _METHODS[method]
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])

    @sliced("array<struct<start: int, end: int, text: string>>", 1)
    def run(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        spans = [cut(t) if t else [] for t in every]
        flat = _spans([x for r in spans for x in r])
        words = pa.array([t[a:b] for t, r in zip(every, spans) for a, b in r], pa.string())
        return _rows([len(r) for r in spans], [pa.array(flat[:, 0]), pa.array(flat[:, 1]), words], item)

    return run(text)


def _spans(flat: list[tuple[int, int]]) -> np.ndarray:
    return np.array(flat, dtype=np.int32).reshape(-1, 2)


def _rows(sizes: list[int], columns: list[pa.Array], item: pa.StructType) -> pa.Array:
    """A list column of structs from flat columns."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)))


def _tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray, list[int]]:
    """Lower-case tokens of all texts, their places and how many each text has."""
    words, places, sizes = [], [], []
    for t in texts:
        w = _PY_TOKEN.findall(t)
        words += [x.lower() for x in w]
        places.append(np.fromiter((x for m in _PY_TOKEN.finditer(t) for x in m.span()), np.int32, 2 * len(w)))
        sizes.append(len(w))
    return pa.array(words, pa.string()), _spans(np.concatenate(places) if places else []), sizes


def locate_tokens(text: Column) -> Column:
    """array<struct<token,start,end>>: lower-case tokens with their places in the text."""
    item = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @sliced("array<struct<token: string, start: int, end: int>>", 1)
    def run(texts: pa.Array) -> pa.Array:
        words, flat, sizes = _tokens([t or "" for t in texts.to_pylist()])
        return _rows(sizes, [words, pa.array(flat[:, 0]), pa.array(flat[:, 1])], item)

    return run(text)


def sentences(docs: DataFrame, method: str = "regex", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_id, start, end, text), a row a sentence."""
    return docs.select(id_col, F.posexplode(segment(F.col(text_col), method)).alias("sent_id", "s")).select(id_col, "sent_id", "s.start", "s.end", "s.text")


def tokens(docs: DataFrame, method: str = "regex", id_col: str = "doc_id", text_col: str = "text", prompt: str | None = None) -> DataFrame:
    """(id, tok_id, token, start, end, sent_id), a row a token.

    A token belongs to the sentence that it lies in entirely; others, and a prompt's tokens, have a null sent_id.  Places count
    from the text's start, so a prompt's are negative.  Sentences and tokens meet in one pass over both sorted lists, within the row.
    """
    shift = len(prompt or "")
    item = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sent_id", pa.int32())])

    member("method", method, SEGMENTERS)
    cut, lead = _METHODS[method], prompt or ""

    @sliced("array<struct<token: string, start: int, end: int, sent_id: int>>", 1, row=16 + shift)
    def assign(texts: pa.Array) -> pa.Array:
        every = [t or "" for t in texts.to_pylist()]
        words, flat, sizes = _tokens([lead + t for t in every])
        flat -= shift
        sents = [cut(t) for t in every]
        bounds = _spans([x for r in sents for x in r]).astype(np.int64)
        # All rows at once: places are moved apart by row, so that one search finds the sentence in which a token begins.
        wide = max((len(t) for t in every), default=0) + shift + 2
        row, own = (np.repeat(np.arange(len(every)), n) for n in (sizes, [len(r) for r in sents]))
        at = np.searchsorted(bounds[:, 0] + own * wide, flat[:, 0] + row * wide, side="right") - 1
        number = np.arange(len(own)) - np.repeat(np.cumsum([0, *map(len, sents)])[:-1], [len(r) for r in sents])
        if len(own):
            inside = (at >= 0) & (own[at] == row) & (flat[:, 1] <= bounds[at, 1])
            sent = np.where(inside, number[at], 0)
        else:
            inside, sent = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=np.int64)
        return _rows(sizes, [words, pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(sent.astype(np.int32), mask=~inside)], item)

    t = F.col(text_col)
    return docs.select(id_col, F.posexplode(assign(t)).alias("tok_id", "t")).select(id_col, "tok_id", "t.token", "t.start", "t.end", "t.sent_id")


def overflow_windows(tokens: Column, max_length: int, stride: int) -> Column:
    """Overlapping runs of a token array: ``max_length`` long, each beginning ``max_length - stride`` behind the last; the final one may be shorter."""
    if not 0 <= stride < max_length:
        raise ValueError("stride must be in [0, max_length)")
    step = max_length - stride
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - stride), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(tokens, s, F.lit(max_length)))


def truncated(tokens: Column, max_length: int, specials: int = 2) -> Column:
    """As many tokens as leave room for the special ones."""
    return F.slice(tokens, 1, max(0, max_length - specials))
