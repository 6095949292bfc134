"""How much results depend on the order of events that share a tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feeds import TOUCH


def mixed_ticks(events: DataFrame) -> DataFrame:
    """symbol, tick, n, trades and touches of the ticks with both a trade and a move of the touch."""
    x = events.groupBy("symbol", "tick").agg(F.count("*").alias("n"), F.count_if(F.col("event_code") >= 8).alias("trades"), F.count_if(F.col("event_code").isin(*TOUCH)).alias("touches"))
    return x.where("trades > 0 AND touches > 0")


def collisions(events: DataFrame) -> DataFrame:
    """symbol, groups, rows, trades, touches of the mixed ticks, and the share of all events in them."""
    total = events.groupBy("symbol").agg(F.count("*").alias("total"))
    x = mixed_ticks(events).groupBy("symbol").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("trades").alias("trades"), F.sum("touches").alias("touches"))
    return total.join(x, "symbol", "left").fillna(0).withColumn("share", F.col("rows") / F.col("total")).drop("total")


def crossing_mask(events: DataFrame) -> DataFrame:
    """events with crossing: whether their tick is mixed."""
    w = Window.partitionBy("symbol", "tick")
    return events.withColumn("crossing", F.max(F.col("event_code") >= 8).over(w) & F.max(F.col("event_code").isin(*TOUCH)).over(w))


def quotes_first(events: DataFrame) -> DataFrame:
    """symbol, event_time, tick, event_code: within each tick the codes of quotes move before those of trades, the
    times keep their places. The order inside each feed stays."""
    tick = Window.partitionBy("symbol", "tick")
    slot = F.row_number().over(tick.orderBy("event_time"))
    place = F.row_number().over(tick.orderBy(F.col("event_code") >= 8, "event_time"))
    x = events.select("symbol", "tick", "event_time", "event_code", slot.alias("s"), place.alias("p"))
    return x.select("symbol", "tick", F.col("s").alias("i"), "event_time").join(x.select("symbol", "tick", F.col("p").alias("i"), "event_code"), ["symbol", "tick", "i"]).drop("i")


BLOCKS = "concat(CASE WHEN source >= 8 THEN 'trade' ELSE 'quote' END, '_to_', CASE WHEN target >= 8 THEN 'trade' ELSE 'quote' END)"


def gamma_change(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By block of a (target, source, value) matrix: norms of the base and of the change, their ratio, the block's share
    of the squared change, and the largest change; for each matrix that `by` names."""
    by = by or []
    x = before.join(after.select(*by, "target", "source", F.col("value").alias("after")), [*by, "target", "source"]).withColumn("d", F.col("after") - F.col("value"))
    x = x.groupBy(*by, F.expr(BLOCKS).alias("block")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("base"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("change"), F.max(F.abs("d")).alias("largest"))
    total = F.sum(F.col("change") * F.col("change")).over(Window.partitionBy(*by, F.lit(0)))  # four rows a matrix
    return x.select(*by, "block", "base", "change", (F.col("change") / F.greatest("base", F.lit(1e-12))).alias("relative"), (F.col("change") * F.col("change") / F.greatest(total, F.lit(1e-24))).alias("share"), "largest")


def top_changes(before: DataFrame, after: DataFrame, k: int = 15) -> DataFrame:
    """The k terms that change most."""
    x = before.join(after.select("target", "source", F.col("value").alias("after")), ["target", "source"]).withColumn("d", F.col("after") - F.col("value"))
    return x.select("target", "source", "value", "after", "d", F.expr(BLOCKS).alias("block")).orderBy(F.abs("d").desc(), "target", "source").limit(k)
