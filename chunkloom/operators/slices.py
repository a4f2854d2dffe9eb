"""Arrow functions that see a batch in slices.

Spark's Arrow batches have up to 10,000 rows, however much each row becomes in Python.  Here a function gets a slice of bounded cost at a
time, and its result is sent before the next slice is looked at, so that a worker holds one batch as it came and what one slice makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: What the rows of a slice cost, see ``ranges``; a row beyond it is a slice of its own.
SLICE = 1 << 20


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of a text, items of a list; null rows have none."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    return np.asarray((pc.binary_length if text else pc.list_value_length)(column).fill_null(0), dtype=np.int64)


def ranges(columns: Sequence[pa.Array], costs: Sequence[int], row: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of a batch that cost at most ``most``: ``row`` each, and ``costs`` for a byte or an item of each column."""
    n = len(columns[0])
    upto = np.append(0, np.cumsum(sum((c * lengths(x) for c, x in zip(costs, columns) if c), np.full(n, row, dtype=np.int64))))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def sliced(kind: str, *costs: int, row: int = 16) -> Callable[[Callable[..., pa.Array]], Callable]:
    """``F.arrow_udf`` for a function of arrays that makes a row of each row and looks at no other rows for it."""
    most = SLICE

    def wrap(f: Callable[..., pa.Array]) -> Callable:
        def cut(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
            for lo, hi in ranges(columns, costs, row, most):
                yield f(*(x.slice(lo, hi - lo) for x in columns))

        if len(costs) == 1:

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for b in batches:
                    yield from cut((b,))
        else:

            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for b in batches:
                    yield from cut(b)

        return F.arrow_udf(kind)(run)

    return wrap
