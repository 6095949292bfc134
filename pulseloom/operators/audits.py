"""Audits of feeds: coverage, gaps, order, spacing, collisions of the feeds, daily summaries and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import small
from .align import WIDTH
from .ordered import bucket_of, previous


def coverage(rows: DataFrame, slot: int = 10, day: int = WIDTH) -> DataFrame:
    """symbol, day, n, inside (rows whose tick is of the day that they are filed under), active (distinct slots of `slot`
    ticks that these take) and percent of the day's slots. rows: symbol, tick and day; without day, that of the tick."""
    own = F.expr(f"floor(tick / {day})")
    x = rows if "day" in rows.columns else rows.withColumn("day", own)
    inside = F.col("day") == own
    x = x.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.countDistinct(F.when(inside, F.expr(f"floor(tick / {slot})"))).alias("active"))
    return x.withColumn("percent", F.col("active") * 100.0 * slot / day)


def gaps(rows: DataFrame, slot: int = 10, day: int = WIDTH) -> DataFrame:
    """symbol, day, n_gaps and longest: runs of slots without a row, the day's edges included."""
    per = day // slot
    x = rows.select("symbol", F.expr(f"floor(tick / {day})").alias("day"), F.expr(f"floor(tick % {day} / {slot})").alias("slot")).distinct()
    edges = x.select("symbol", "day").distinct().select("symbol", "day", F.explode(F.array(F.lit(-1), F.lit(per))).alias("slot"))
    x = previous(x.withColumn("slot", F.col("slot").cast("long")).unionByName(edges.withColumn("slot", F.col("slot").cast("long"))).withColumn("tick", F.col("day") * (per + 2) + F.col("slot") + 1), ["symbol", "day"], ["slot"], ["slot"], "p", F.lit(0))
    run = F.col("slot") - F.col("p.slot") - 1
    return x.groupBy("symbol", "day").agg(F.count_if(run > 0).alias("n_gaps"), F.coalesce(F.max(run), F.lit(0)).alias("longest"))


def order_violations(rows: DataFrame, order: str = "row", by=("symbol", "file"), time: str = "tick", ident: str = "id", width: int = 1_000_000) -> DataFrame:
    """by, back (rows whose time is below that of the row before, by `order`) and ids (same time, lower id).

    Rows as files.in_file_order() reads them have the order in which they lie in their files.
    """
    x = previous(rows, list(by), [order], [time, ident], "p", F.expr(f"floor({order} / {width})"))
    return x.groupBy(*by).agg(F.count_if(F.col(time) < F.col(f"p.{time}")).alias("back"), F.count_if((F.col(time) == F.col(f"p.{time}")) & (F.col(ident) < F.col(f"p.{ident}"))).alias("ids"))


def spacing(rows: DataFrame, near: int = 10, ident: str = "update_id") -> DataFrame:
    """symbol, n and share of gaps between rows that are under `near` ticks."""
    x = previous(rows, ["symbol"], ["tick", ident], ["tick"], "p", bucket_of("tick", WIDTH)).where("p IS NOT NULL")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("tick") - F.col("p.tick") < near).cast("double")).alias("near"))


def crowding(book: DataFrame, trades: DataFrame, near: int = 10) -> DataFrame:
    """spacing() of the book with share, the part of its ticks that have trades too, and normalised, that over the share of
    near gaps (null without any)."""
    x = spacing(book, near).join(shared_ticks(book, trades).select("symbol", "share"), "symbol")
    return x.withColumn("normalised", F.when(F.col("near") > 0, F.col("share") / F.col("near")))


def shared_ticks(book: DataFrame, trades: DataFrame) -> DataFrame:
    """symbol, book_ticks, shared (ticks of the book that have trades too) and their share."""
    b, t = (x.select("symbol", "tick").distinct() for x in (book, trades))
    x = b.join(t.withColumn("__t", F.lit(1)), ["symbol", "tick"], "left")
    return x.groupBy("symbol").agg(F.count("*").alias("book_ticks"), F.count("__t").alias("shared")).withColumn("share", F.col("shared") / F.col("book_ticks"))


def daily_summary(trades: DataFrame, day: int = WIDTH) -> DataFrame:
    """symbol, day, n, volume, turnover and realised volatility (root of summed squared log returns of the day)."""
    x = trades.withColumn("day", F.expr(f"floor(tick / {day})"))
    x = previous(x, ["symbol", "day"], ["tick", "id"], ["price"], "p", bucket_of("tick", 60))
    step = F.ln("price") - F.ln(F.col("p.price"))
    return x.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.sum(F.col("qty") * F.col("price")).alias("turnover"), F.sqrt(F.coalesce(F.sum(step * step), F.lit(0.0))).alias("volatility"))


def robust_z(days: DataFrame, value: str, train: str, limit: float = 3.5) -> DataFrame:
    """days with z = (value - median) / (1.4826 MAD) and flag = |z| > limit, with median and MAD over the rows of the
    symbol for which `train` holds; z is null where the MAD is 0."""
    base = days.where(train)
    med = base.groupBy("symbol").agg(F.percentile(value, 0.5).alias("__m"))
    mad = base.join(med, "symbol").groupBy("symbol").agg(F.percentile(F.abs(F.col(value) - F.col("__m")), 0.5).alias("__d"))
    x = days.join(med, "symbol").join(mad, "symbol")
    z = F.when(F.col("__d") > 0, (F.col(value) - F.col("__m")) / (1.4826 * F.col("__d")))
    return x.withColumn("z", z).withColumn("flag", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("__m", "__d")


def without_gaps(windows: DataFrame, known: DataFrame) -> DataFrame:
    """windows (start, end) that overlap none of the known gaps (gap_start, gap_end), which are broadcast if they are few."""
    hit = (F.col("start") < F.col("gap_end")) & (F.col("gap_start") < F.col("end"))
    return windows.join(small(known, "gaps"), hit, "left_anti")
