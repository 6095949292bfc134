"""Forecast metrics and predictive-ability tests."""

from __future__ import annotations

from math import ceil, erfc, floor, isfinite, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.files import small


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(y - p, 2))


def log_loss(y: Column, p: Column) -> Column:
    """Of one row; the probability is kept 1e-12 away from 0 and 1. Null without one."""
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))  # these pass over nulls
    return F.when(p.isNotNull(), -(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def ranked(df: DataFrame, score: str, order: list[str], by: list[str] | None = None, y: Column | None = None, buckets: int = 64) -> DataFrame:
    """df with rank, the row's place in its group by falling score, then by `order`; with y also ones, the sum of y up to it.

    Scores are cut into ranges by each group's approximate quantiles. A score that takes several quantiles is a range
    of its own, cut again by ranges of the first of `order`, if that is a number. A row's place is its place in its
    range plus the rows of the ranges before; no task holds more than a range.
    """
    by = by or []
    steps = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    number = isinstance(df.schema[order[0]].dataType, NumericType)
    cuts = [F.percentile_approx(score, steps, 10_000).alias("__c"), (F.percentile_approx(order[0], steps, 10_000) if number else F.array().cast("array<double>")).alias("__o")]
    found = small(df.groupBy(*by).agg(*cuts), "cuts")  # a row per group
    x = df.join(found, by) if by else df.crossJoin(found)
    often = F.size(F.filter("__c", lambda c: c == F.col(score))) > 1
    x = x.withColumn("__part", 2 * F.size(F.filter(F.array_distinct("__c"), lambda c: c > F.col(score))) + often.cast("int"))
    x = x.withColumn("__sub", F.when(often, F.size(F.filter("__o", lambda o: o < F.col(order[0])))).otherwise(0)).drop("__c", "__o")
    ones = F.lit(0) if y is None else y
    sizes = x.groupBy(*by, "__part", "__sub").agg(F.count("*").alias("__n"), F.sum(ones).alias("__m"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__part", "__sub").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    above = sizes.select(*by, "__part", "__sub", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_above") for c in ("__n", "__m")))
    own = Window.partitionBy(*by, "__part", "__sub").orderBy(F.col(score).desc(), *order)
    x = x.withColumn("rank", F.row_number().over(own)).withColumn("ones", F.sum(ones).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(above, [*by, "__part", "__sub"]).withColumns({"rank": F.col("rank") + F.col("__n_above"), "ones": F.col("ones") + F.col("__m_above")})
    return x.drop("__part", "__sub", "__n_above", "__m_above", *([] if y is not None else ["ones"]))


def average_precisions(df: DataFrame, by: list[str], y: str, score: str, order: list[str]) -> DataFrame:
    """by, positives and average_precision (null without positives) of each group. Ties of the score stand in `order`;
    rows without a score don't count.

    The precision at a positive is its number among positives over its rank.
    """
    x = ranked(df.where(F.col(score).isNotNull()), score, order, by, F.col(y).cast("long"))
    return x.groupBy(*by).agg(F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("positives"), F.avg(F.when(F.col(y) == 1, F.col("ones") / F.col("rank"))).alias("average_precision"))


def average_precision(df: DataFrame, y: str, score: str, order: list[str]) -> DataFrame:
    """One row: positives, average_precision."""
    return average_precisions(df, [], y, score, order)


def order_statistic(df: DataFrame, value: str, share: float, order: list[str]) -> float | None:
    """The interpolated quantile `share` of a column without nulls, read at its two ranks; None of nothing."""
    n = df.count()
    if not n:
        return None
    at = (n - 1) * share
    low, high = n - floor(at), n - ceil(at)  # ranks fall as values rise
    found = {r["rank"]: float(r[value]) for r in ranked(df, value, order).where(F.col("rank").isin(low, high)).select("rank", value).collect()}
    return found[low] + (found[high] - found[low]) * (at - floor(at))


def alert_metrics(df: DataFrame, y: str, score: str, lead: str, order: list[str], rate: float = 0.01) -> DataFrame:
    """One row: the score's quantile 1 - rate (interpolated), the share of rows at or above it, the share of positives
    among them, and the median of `lead` over the positives caught."""
    threshold = order_statistic(df, score, 1.0 - rate, order)
    hit = (F.col(score) >= F.lit(threshold)) & (F.col(y) == 1)
    median = order_statistic(df.where(hit & F.col(lead).isNotNull()), lead, 0.5, order)
    x = df.agg(F.avg((F.col(score) >= F.lit(threshold)).cast("double")).alias("alert_rate"), (F.count_if(hit) / F.greatest(F.lit(1), F.sum(y))).alias("recall"))
    return x.select(F.lit(threshold).cast("double").alias("threshold"), "alert_rate", "recall", F.lit(median).cast("double").alias("median_lead"))


def block_means(df: DataFrame, time: Column, loss_a: Column, loss_b: Column) -> DataFrame:
    """block and the mean difference of the losses."""
    return df.groupBy(time.alias("block")).agg(F.avg(loss_a - loss_b).alias("diff"))


def lag_count(n: int) -> int:
    return min(n - 1, floor(4 * (n / 100) ** (2 / 9)))


def autocovariances(blocks: DataFrame, lags: int | None = None) -> tuple[int, float, list[float]]:
    """Number of blocks, their mean, and the sums over n of products of centred values 0 to L blocks apart.

    Blocks are numbered within ranges of 4,096 block values plus the blocks before; each lag is an equi-join in disguise:
    every row also stands as the one L places later, and rows meet by number.
    """
    x = blocks.where(F.col("diff").isNotNull() & ~F.isnan("diff"))
    n, mean = x.agg(F.count("*"), F.avg("diff")).first()
    if n < 3:
        return n, mean, []
    lags = lag_count(n) if lags is None else lags
    x = x.withColumn("__r", F.expr("floor(block / 4096)"))
    sizes = x.groupBy("__r").count().select("__r", F.coalesce(F.sum("count").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    x = x.join(sizes, "__r").select((F.row_number().over(Window.partitionBy("__r").orderBy("block")) + F.col("__n")).alias("i"), (F.col("diff") - mean).alias("c"))
    later = x.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i", F.col("c").alias("d")).select("lag", (F.col("i") + F.col("lag")).alias("i"), "d")
    sums = {r["lag"]: r["s"] for r in later.join(x, "i").groupBy("lag").agg(F.sum(F.col("c") * F.col("d")).alias("s")).collect()}
    return n, mean, [sums.get(k, 0.0) / n for k in range(lags + 1)]


def mean_test(blocks: DataFrame, lags: int | None = None) -> dict:
    """Mean of the blocks, its Newey-West t statistic with Bartlett weights, and the two-sided normal p-value; NaN
    with fewer than three blocks or no variance."""
    n, mean, cov = autocovariances(blocks, lags)
    nan = float("nan")
    if n < 3:
        return {"blocks": n, "mean": nan, "statistic": nan, "p_value": nan}
    last = len(cov) - 1
    long_run = cov[0] + sum(2 * (1 - k / (last + 1)) * cov[k] for k in range(1, last + 1))
    se = sqrt(max(long_run, 0.0) / n)
    stat = mean / se if se > 0 else nan
    return {"blocks": n, "mean": mean, "statistic": stat, "p_value": two_sided(stat)}


def two_sided(statistic: float) -> float:
    """The normal tails beyond a statistic."""
    return erfc(abs(statistic) / sqrt(2)) if isfinite(statistic) else float("nan")


def giacomini_white(df: DataFrame, time: Column, loss_a: Column, loss_b: Column) -> dict:
    return mean_test(block_means(df, time, loss_a, loss_b))


def day_moments(df: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """By day: n, and for each column the sum of x - mean and of its square (the mean is over all rows)."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centred = {c: F.col(c) - F.lit(means[c]) for c in columns}
    return df.groupBy(day).agg(F.count("*").alias("n"), *(F.sum(v).alias(f"{c}_s") for c, v in centred.items()), *(F.sum(v * v).alias(f"{c}_ss") for c, v in centred.items()))


def romano_wolf(df: DataFrame, day: str, columns: list[str], replications: int = 2000, seed: int = 5) -> dict[str, float]:
    """Stepdown p-values of the columns' means, by a bootstrap of whole days.

    A replicate's t needs only how often it draws each day and the days' numbers of rows, sums and sums of squares, so
    the days' moments are all that is fetched, and a matrix of counts makes all replicates at once.
    """
    centre = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    rows = day_moments(df, day, columns).orderBy(day).collect()
    moments = np.array([[r["n"], *(r[f"{c}_s"] for c in columns), *(r[f"{c}_ss"] for c in columns)] for r in rows], float)

    def size_of_t(sums: np.ndarray, shift) -> np.ndarray:
        n, s, ss = sums[:, :1], sums[:, 1 : 1 + len(columns)], sums[:, 1 + len(columns) :]
        spread = np.sqrt(np.maximum(ss - s * s / n, 0) / (n - 1) / n)
        return np.abs(s / n + shift) / np.maximum(spread, 1e-12)

    observed = size_of_t(moments.sum(0, keepdims=True), np.array([centre[c] for c in columns]))[0]
    draws = np.random.default_rng(seed).multinomial(len(rows), np.full(len(rows), 1 / len(rows)), replications)
    rank = np.argsort(-observed, kind="stable")
    null = size_of_t(draws @ moments, 0.0)[:, rank]
    rest = np.maximum.accumulate(null[:, ::-1], 1)[:, ::-1]  # the largest of a hypothesis and those after it
    p = np.maximum.accumulate((rest >= observed[rank]).mean(0))
    return {columns[i]: float(v) for i, v in zip(rank, p, strict=True)}
