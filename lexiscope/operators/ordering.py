"""Running sums over an order that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.session import materialise


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with, for each name, the sum of its column over the rows before in the order, within `by`.

    Rows are dealt out by ranges of (by, order) and written, so that a range keeps its rows; each range sums its
    own, and gets the totals of the ranges before, a row for each, added. Rows of equal order have no order among them."""
    key = F.col(order).desc() if descending else F.col(order).asc()
    x = df.withColumns({f"__own_{n}": c for n, c in sums.items()})
    x = materialise(x.repartitionByRange(*by, key).withColumn("__range", F.spark_partition_id()))
    totals = x.groupBy(*by, "__range").agg(*[F.sum(f"__own_{n}").alias(f"__all_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in sums])
    within = Window.partitionBy(*by, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__own_{n}").over(within), F.lit(0)) for n in sums})
    on = F.col("__range") == F.col("__r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return x.join(offset, on).select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums])
