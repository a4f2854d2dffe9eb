"""Tokenizers with a vocabulary, from public files of the ``tokenizers`` package; nothing is trained or copied."""

from __future__ import annotations

import numpy as np

_loaded: dict[int, object] = {}


class VocabularyTokenizer:
    """Token ids and places of texts.  The file is read where this is made and goes to tasks as it is, so that executors need none.

    ``cls``, ``sep`` and ``pad`` are special tokens of the vocabulary; None leaves one out (id 0 pads then).
    """

    def __init__(self, path: str, cls: str | None = None, sep: str | None = None, pad: str | None = None, max_length: int | None = None):
        with open(path, encoding="utf-8") as f:
            self.raw = f.read()
        self.max_length = max_length
        ids = [self._id(x) for x in (cls, sep, pad)]
        self.ends, self.pad = (ids[0], ids[1]), ids[2] or 0

    def _get(self):
        key = hash(self.raw)
        if key not in _loaded:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(self.raw)
            t.no_padding()
            t.no_truncation()
            t.encode_special_tokens = True  # what a text says is text
            _loaded[key] = t
        return _loaded[key]

    def _id(self, token: str | None) -> int | None:
        if token is None:
            return None
        if (got := self._get().token_to_id(token)) is None:
            raise ValueError(f"the vocabulary has no token {token!r}")
        return got

    @property
    def size(self) -> int:
        return self._get().get_vocab_size()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, [start, end) in characters, tokens of each text), texts one after another."""
        found = self._get().encode_batch([t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts], add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.array([x for r in ids for x in r], dtype=np.int64)
        return flat, np.array([x for e in found for x in e.offsets], dtype=np.int64).reshape(-1, 2), np.array([len(r) for r in ids], dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        return self._get().decode(list(ids), skip_special_tokens=False)

    def check(self, ids: np.ndarray) -> None:
        """An error for ids that the vocabulary doesn't have: they were made with another one."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < self.size:
            raise ValueError(f"token ids from {ids.min()} to {ids.max()}, but the vocabulary has {self.size}")
