"""Public byte-level BPE vocabularies: the path of a rank file is a parameter, nothing is copied or trained."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, tiktoken.Encoding] = {}


class Vocabulary:
    """A rank file, read where this is made.  It goes to tasks as bytes, so that executors need no file; special strings are ordinary text."""

    def __init__(self, path: str = VOCABULARY):
        self.path = path
        with open(path, "rb") as f:
            self.raw = f.read()

    def encoding(self) -> tiktoken.Encoding:
        """The tokenizer, made once in each Python process."""
        if self.path not in _loaded:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.raw.splitlines() if line.strip())}
            _loaded[self.path] = tiktoken.Encoding(self.path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _loaded[self.path]


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    return _loaded[path] if path in _loaded else Vocabulary(path).encoding()


def ids(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """Token ids; what UTF-8 can't hold is replaced."""
    try:
        return enc.encode_to_numpy(text, disallowed_special=())
    except UnicodeEncodeError:
        return enc.encode_to_numpy(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), disallowed_special=())


def token_ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    return ids(text, encoding(path))
