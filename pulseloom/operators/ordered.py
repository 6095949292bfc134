"""Order-dependent building blocks that split a long stream into buckets of time.

A window over a whole symbol would put it into one task. Here windows end at bucket borders; what must cross
them is one carried value per bucket, or rows that are dealt to every bucket that looks at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(df: DataFrame, by: list[str], order: list[str], value: str, to: str, bucket: Column, strict: bool = False, backward: bool = False) -> DataFrame:
    """df with column `to`: the last non-null `value` up to each row in the order (before it, if strict).

    backward looks the other way: the next non-null value. `bucket` must not fall as the order rises.
    """
    df = df.withColumn("__b", bucket)
    turned = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    local = F.last(F.col(value), True).over(Window.partitionBy(*by, "__b").orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    key = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(*by, "__b").agg((F.min_by if backward else F.max_by)(F.col(value), key).alias("__v"))
    past = Window.partitionBy(*by).orderBy(F.col("__b").desc() if backward else F.col("__b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__b", F.last("__v", True).over(past).alias("__c"))
    return df.join(ends, [*by, "__b"]).withColumn(to, F.coalesce(local, F.col("__c"))).drop("__b", "__c")


def previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], to: str, bucket: Column) -> DataFrame:
    """df with column `to`: a struct of `columns` of the row before, null for the first."""
    return last_known(df.withColumn("__self", F.struct(*columns)), by, order, "__self", to, bucket, strict=True).drop("__self")


def haloed(df: DataFrame, time: str, width: int, back: int, ahead: int) -> DataFrame:
    """df with column bucket, each row once for every bucket of `width` ticks from which windows of `back` ticks
    before and `ahead` ticks after a point of the bucket can reach it."""
    low, high = F.expr(f"floor(({time} - {ahead}) / {width})"), F.expr(f"floor(({time} + {back}) / {width})")
    return df.withColumn("bucket", F.explode(F.sequence(low, high)))


def bucket_of(time: str, width: int) -> Column:
    return F.expr(f"floor({time} / {width})")
