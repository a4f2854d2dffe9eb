"""A global row number that doesn't pull all rows into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.tables import stored

#: ``monotonically_increasing_id`` has a row's partition above and its place in the partition below this bit.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """(idx, ...): 0-based numbers in the given order, which should be total; rows that tie get numbers in any order.

    The table is range-partitioned and sorted once and stored with each row's partition and place, so that all that
    follows sees the same partitions.  Only the partitions' sizes, a row each, are added up in one place.
    """
    at, before, part = (f"__{name}_{x}" for x in ("at", "before", "part"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = stored(ranged, "numbered").withColumn(part, F.shiftright(at, _PLACE_BITS))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    number = F.col(before) + F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1)
    return rows.join(starts, part).select(number.alias(name), *(F.col(f"`{c}`") for c in df.columns))
