"""Running sums over an order that no task holds as a whole.

Values are dealt into ranges of the order first; sums over the ranges, of which there are a bounded number, are added
to the sums inside each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which an order is dealt.
RANGES = 256


def ranged(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``, which grows with a numeric column; borders are approximate quantiles, so that ranges are
    about equal, and nulls are in the first.
    """
    value = F.col(column).cast("double")
    borders = sorted(set(df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)] or [0.5], 4 * ranges)).first()[0] or []))
    placed = F.sort_array(F.array_append(F.array(*map(F.lit, borders)).cast("array<double>"), value))
    return df.withColumn("_range", F.coalesce(F.array_position(placed, value), F.lit(0)))


def summed_before(df: DataFrame, column: str, keys: Sequence[str] = (), ranges: int = RANGES, **sums: Column) -> DataFrame:
    """``df`` with, for each name, the sum of a column over the rows before each one in the order of ``column``, by ``keys``.

    ``column`` must tell the rows of a key apart.
    """
    dealt = ranged(df, column, ranges)
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.toDF(*[f"_at_{k}" for k in keys], "_at", *[f"_{n}" for n in sums])
    same = F.col("_range") == F.col("_at")
    for k in keys:  # a null key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    found = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(totals, same)
    return found.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
