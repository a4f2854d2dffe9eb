"""Batches for an encoder: order, token budgets, padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import layout


def power_of_two(n: Column) -> Column:
    """The least power of two that isn't below n; exact, from the binary digits."""
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.expr("1L") * F.pow(F.lit(2), F.length(F.bin(n.cast("bigint") - 1))).cast("bigint"))


def padded(a: Column, value: Column, size: Column) -> Column:
    return F.concat(a, F.array_repeat(value, (size - F.size(a)).cast("int")))


def batch_plan(rows: DataFrame, id_col: str, size_col: str, budget: int, by: str | None = None) -> DataFrame:
    """([by,] id, size, batch_no, batch_rows, width): longest first, greedy batches of ``budget`` padded tokens at most.

    ``batch_no`` counts within each value of ``by``, which is what an encoder's task gets; without it within the partitions
    that the table has, without a shuffle.  A row beyond the budget is a batch of its own.
    """
    keys = [by] if by else []
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, id_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not by:
                held.append(b)
                continue
            part = b.column(0)
            cuts = [0, *(np.flatnonzero(np.asarray(pc.not_equal(part[1:], part[:-1]).fill_null(True))) + 1).tolist(), len(b)] if len(b) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0] != part[lo]:
                    yield planned(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield planned(held)

    def planned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        sizes = t.column(size_col).to_numpy()
        no = np.array(layout.token_batches(sizes.tolist(), budget), dtype=np.int64)
        n = np.bincount(no) if len(no) else np.zeros(0, dtype=np.int64)
        width = np.zeros(len(n), dtype=np.int64)
        np.maximum.at(width, no, sizes)
        wide = np.array([layout.power_of_two(w) for w in width], dtype=np.int64)
        first = [t.column(c).combine_chunks() for c in (*keys, id_col)]
        return pa.RecordBatch.from_arrays([*first, pa.array(sizes.astype(np.int64)), pa.array(no), pa.array(n[no]), pa.array(wide[no])], [*keys, id_col, size_col, "batch_no", "batch_rows", "width"])

    ordered = rows.select(*keys, id_col, F.col(size_col).cast("bigint"))
    ordered = ordered.repartition(by).sortWithinPartitions(by, F.desc(size_col), id_col) if by else ordered.sortWithinPartitions(F.desc(size_col), id_col)
    return ordered.mapInArrow(run, ", ".join([*kinds, f"{size_col} bigint", "batch_no bigint", "batch_rows bigint", "width bigint"]))
