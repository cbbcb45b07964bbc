"""A global order over ids without one task that sees all rows: ranges of ids with bounds
that are plain numbers, so that every evaluation deals rows alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bounds(ids: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 rising numbers that cut the ids into ranges, from approximate quantiles."""
    if n <= 1:
        return []
    bounds = ids.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted(set(bounds or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number, from 0, of the range that an id falls in: how many bounds it reaches, by binary search
    over one constant array; null ids are in the first range."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
