"""The two market feeds: their schemas, and feeds derived from a table of generic events.

A feed's time is an integer count of ticks. Derived feeds use minutes as ticks, where market data has
milliseconds; all operators take their durations in ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

#: The columns of the public feeds' files.
TRADES = StructType().add("id", LongType()).add("price", DoubleType()).add("qty", DoubleType()).add("quote_qty", DoubleType()).add("time", LongType()).add("is_buyer_maker", BooleanType())
QUOTES = (
    StructType().add("update_id", LongType()).add("best_bid_price", DoubleType()).add("best_bid_qty", DoubleType()).add("best_ask_price", DoubleType()).add("best_ask_qty", DoubleType())
    .add("transaction_time", LongType()).add("event_time", LongType())
)
FEEDS = {"trades": TRADES, "bookTicker": QUOTES}

#: Event types by code: changes of the best bid, of the best ask, trades.
EVENT_TYPES = ("bid_qty_up", "bid_qty_down", "bid_price_up", "bid_price_down", "ask_qty_up", "ask_qty_down", "ask_price_up", "ask_price_down", "trade_buy", "trade_sell")
TOUCH = (2, 3, 6, 7)
BUY, SELL = 8, 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    tick = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 60000000")
    return e.select("event_id", "event_type", "user_id", tick.alias("tick"), F.expr("(event_id div 11) % 3").alias("k"), F.concat(F.lit("S"), F.expr("(user_id div 2) % 2")).alias("symbol"))


def derived_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, id, tick, price, qty, is_buyer_maker from the purchases of `events`."""
    e = _ticks(spark, sf_dir).where("event_type = 'purchase'")
    maker = F.col("user_id") % 2 == 1
    return e.select("symbol", F.col("event_id").alias("id"), "tick", (100.0 + 0.5 * F.col("k") - F.when(maker, 0.5).otherwise(0.0)).alias("price"), (1.0 + F.col("event_id") % 5).alias("qty"), maker.alias("is_buyer_maker"))


def derived_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, update_id, tick and the best bid's and ask's price and qty from the other events."""
    e = _ticks(spark, sf_dir).where("event_type <> 'purchase'")
    return e.select(
        "symbol", F.col("event_id").alias("update_id"), "tick", (99.5 + 0.5 * F.col("k")).alias("bid_price"), (5.0 + F.col("event_id") * 7 % 13).alias("bid_qty"),
        (100.0 + 0.5 * F.col("k")).alias("ask_price"), (5.0 + F.col("event_id") * 5 % 11).alias("ask_qty"),
    )
