"""Running sums over one order of all rows, or of each group's rows, without bringing them into one task.

Rows are dealt to range partitions of the order, so a range is a partition: a window of its own sums it, and the totals of the ranges before
it are added. Ranges are cut by the sample that Spark draws for a range partitioning; nothing comes to the driver. The dealt rows are checkpointed,
so that a row's range is the same wherever it is read, and the source is not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def ranges(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows with `range`, ascending in the order of the keys (nulls first); rows with equal keys share one.
    rows: of a range, about; by default Spark's size of a partition."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(*order) if rows is None else df.repartitionByRange(max(1, -(-df.count() // rows)), *order)
    return cut(dealt.withColumn("range", F.spark_partition_id()))


def running(df: DataFrame, key: str, sums: dict[str, Column], rows: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows with inclusive running sums in the order of the key, which no two rows (of a group `by`) share."""
    parts = ranges(df.withColumns({f"_{c}": v for c, v in sums.items()}), *by, key, rows=rows)
    totals = parts.groupBy(*by, "range").agg(*(F.sum(f"_{c}").alias(f"total_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(*(F.col(b).alias(f"of_{b}") for b in by), F.col("range").alias("of_range"), *(F.coalesce(F.sum(f"total_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    own = Window.partitionBy(*by, "range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range") == F.col("of_range")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"of_{b}"))
    out = parts.join(totals, same)
    out = out.withColumns({c: F.col(f"before_{c}") + F.coalesce(F.sum(f"_{c}").over(own), F.lit(0)) for c in sums})
    return out.drop("range", "of_range", *(f"of_{b}" for b in by), *(f"{p}{c}" for c in sums for p in ("_", "before_")))
