"""Running sums, numbers and previous rows in a global order, without one task for all rows of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routecover.runtime import settled

SLICE = "__slice"


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, sums: Mapping[str, Column] | None = None, previous: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with running sums (the row's own value included) and values of the row before, within ``keys`` in ``order``.

    Rows are range-partitioned by keys and order, so a key of any size spans many slices. Each slice is summed by itself, and a table
    of slices (at most one row for each key and slice) gives what came before it. ``previous`` takes a column's value in the row before, null in
    the first; its ``order`` holds names of ascending columns. Keys are not null. Rows equal in ``order`` follow each other in any order.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({f"__v_{n}": v for n, v in sums.items()}) if sums else df
    rows = settled(rows.repartitionByRange(*(F.col(k) for k in keys), *by).withColumn(SLICE, F.spark_partition_id()))
    own = [F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums] + [F.max_by(c, F.struct(*by)).alias(f"__p_{n}") for n, c in previous.items()]
    along = Window.partitionBy(*keys).orderBy(SLICE)
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    before = [F.sum(f"__b_{n}").over(upto).alias(f"__b_{n}") for n in sums] + [F.lag(f"__p_{n}").over(along).alias(f"__p_{n}") for n in previous]
    slices = settled(rows.groupBy(*keys, SLICE).agg(*own).select(*keys, SLICE, *before))
    within = Window.partitionBy(*keys, SLICE).orderBy(*by)
    here = {f"__v_{n}": F.sum(f"__v_{n}").over(within.rowsBetween(Window.unboundedPreceding, 0)) for n in sums}
    here |= {f"__l_{n}": F.lag(c).over(within) for n, c in previous.items()} | {"__n": F.row_number().over(within)}
    out = rows.withColumns(here).join(slices, [*keys, SLICE])
    last = [(F.col(f"__v_{n}") + F.coalesce(F.col(f"__b_{n}"), F.lit(0))).alias(n) for n in sums]
    last += [F.when(F.col("__n") == 1, F.col(f"__p_{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in previous]
    return out.select(*(c for c in df.columns if c not in sums and c not in previous), *last)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """``df`` with the row's place within ``keys`` in ``order``, from 1."""
    return scanned(df, keys, order, sums={name: F.lit(1).cast("long")})
