import random
import re

import pytest

EXTRA = "id long, key long, a long, b long, rule long, language string, gone_id long, turn long, null_key long, mark long, token string, g long"


def words(text):
    """What the operators take for words, in plain Python."""
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(text, k):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


@pytest.fixture(scope="session")
def prose():
    """Makes texts of invented words."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
        return " ".join(r.choice(vocab) + (". " if r.random() < 0.08 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents with more columns than needed, whose names the operators use inside."""

    def make(rows, extra=True, n_chars=True):
        full = [(i, t, "en", "s", len(t) if t is not None else None) + ((None, 1, 2, 3, 4, "x", 5, 6, 7, 8, "t", 9) if extra else ()) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else ""))

    return make


ODD = [(None, "some words without an id here"), (1, None), (2, ""), (3, "   \n\t "), (4, "...!?"), (5, "one"), (5, "one"), (6, "\U0001f600 ünï \x00 ﬁn"), (7, "x" * 200_000), (8, "a b " * 50_000)]


@pytest.fixture(scope="session")
def odd(table):
    """Nulls, blanks, repeated rows, very long texts, strange characters, clashing columns."""
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table, spark):
    return table([(1, "x")]).where("false")
