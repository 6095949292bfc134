"""Typing of quote changes, attribution of trades to them, and the causal merge of both feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feeds import BUY, EVENT_TYPES, SELL
from .ordered import bucket_of, last_known, previous

EPS = 1e-12
UNIT = 10_000  # event-time units in a tick; an event's rank in its tick fills them
WIDTH = 1440
QUOTE = ["bid_price", "bid_qty", "ask_price", "ask_qty"]
RULES = ("trades_first", "book_first")


def directions(trades: DataFrame) -> DataFrame:
    """trades with event_code: a buyer who was the maker means a sale."""
    return trades.withColumn("event_code", F.when(F.col("is_buyer_maker"), SELL).otherwise(BUY))


def transitions(book: DataFrame, width: int = WIDTH) -> DataFrame:
    """book with prev, the quote before it in (tick, update_id) order; null for a symbol's first."""
    return previous(book, ["symbol"], ["tick", "update_id"], QUOTE, "prev", bucket_of("tick", width))


def matched_quotes(quotes: DataFrame, trades: DataFrame, rule: str = "trades_first", width: int = WIDTH) -> DataFrame:
    """trades with match, a struct of update_id and prev of the first quote at or after the trade (trades_first) or
    strictly after it (book_first); null if there is none."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    late = rule == "book_first"
    q = quotes.select("symbol", "tick", F.lit(0 if late else 1).alias("kind"), F.col("update_id").alias("id"), F.struct("update_id", "prev").alias("quote"), F.lit(None).cast("struct<price:double,qty:double,maker:boolean>").alias("trade"))
    t = trades.select("symbol", "tick", F.lit(1 if late else 0).alias("kind"), "id", F.lit(None).cast(q.schema["quote"].dataType).alias("quote"), F.struct("price", "qty", F.col("is_buyer_maker").alias("maker")).alias("trade"))
    x = last_known(q.unionByName(t), ["symbol"], ["tick", "kind", "id"], "quote", "match", bucket_of("tick", width), backward=True)
    return x.where("trade IS NOT NULL").select("symbol", "tick", "id", "trade.price", "trade.qty", F.col("trade.maker").alias("is_buyer_maker"), "match")


def attributed(quotes: DataFrame, trades: DataFrame, rule: str = "trades_first", width: int = WIDTH) -> DataFrame:
    """quotes with bid_traded and ask_traded: volume of the trades matched to the quote at the price of its side before.

    A symbol's first quote has no state before it and gets none.
    """
    m = matched_quotes(quotes, trades, rule, width).where("match.prev IS NOT NULL")
    at = lambda side: F.sum(F.when(F.col("price") == F.col(f"match.prev.{side}_price"), F.col("qty")))
    sums = m.groupBy("symbol", F.col("match.update_id").alias("update_id")).agg(at("bid").alias("bid_traded"), at("ask").alias("ask_traded"))
    return quotes.join(sums, ["symbol", "update_id"], "left").fillna(0.0, ["bid_traded", "ask_traded"])


def _side(side: str, first: int) -> tuple[Column, Column, Column]:
    """Code of the side's event (null if none), its volume, and whether trades explain a drop whole."""
    price, qty = F.col(f"{side}_price"), F.col(f"{side}_qty")
    was, had = F.col(f"prev.{side}_price"), F.col(f"prev.{side}_qty")
    delta = qty - had
    rest = F.greatest(F.lit(0.0), -delta - F.col(f"{side}_traded"))
    drop = (price == was) & (delta < -EPS)
    code = F.when(price > was, first + 2).when(price < was, first + 3).when((price == was) & (delta > EPS), first).when(drop & (rest > EPS), first + 1)
    volume = F.when(price != was, qty).when(delta > EPS, delta).otherwise(rest)
    return code, volume, drop & (rest <= EPS)


def quote_events(quotes: DataFrame) -> DataFrame:
    """Up to two events of each attributed quote: symbol, tick, source_id, side, event_code, price, volume."""
    made = []
    for side, (name, first) in enumerate((("bid", 0), ("ask", 4))):
        code, volume, _ = _side(name, first)
        made.append(F.struct(F.lit(side).alias("side"), code.alias("event_code"), F.col(f"{name}_price").alias("price"), volume.alias("volume")))
    x = quotes.where("prev IS NOT NULL").select("symbol", "tick", F.col("update_id").alias("source_id"), F.inline(F.array(*made)))
    return x.where("event_code IS NOT NULL")


def explained_drops(quotes: DataFrame) -> DataFrame:
    """symbol and the numbers of drops of either side that trades explain."""
    q = quotes.where("prev IS NOT NULL")
    return q.groupBy("symbol").agg(*(F.count_if(_side(s, 0)[2]).alias(f"{s}_explained") for s in ("bid", "ask")))


def merged(quotes: DataFrame, trades: DataFrame, rule: str = "trades_first", most: int = UNIT) -> DataFrame:
    """One stream of typed events in causal order: event_time is tick * UNIT + rank within the tick.

    Within a tick one feed stands before the other by the rule, then the source's id and the side decide. A tick
    with `most` events or more is an error, as ranks would reach the next tick. Ranks run over the whole tick,
    also where it is a symbol's first.
    """
    q = quote_events(quotes).withColumn("feed", F.lit(1 if rule == "trades_first" else 0)).withColumn("source", F.lit("bookTicker"))
    t = directions(trades).select("symbol", "tick", F.col("id").alias("source_id"), F.lit(0).alias("side"), "event_code", "price", F.col("qty").alias("volume"), F.lit(0 if rule == "trades_first" else 1).alias("feed"), F.lit("trades").alias("source"))
    x = q.unionByName(t)
    rank = F.row_number().over(Window.partitionBy("symbol", "tick").orderBy("feed", "source_id", "side")) - 1
    x = x.withColumn("rank", rank)
    rank = F.when(F.col("rank") < most, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("too many events in tick "), F.col("tick"))).cast("int"))
    name = F.element_at(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_code") + 1)
    return x.select("symbol", (F.col("tick") * UNIT + rank).alias("event_time"), "tick", "event_code", name.alias("event_type"), "price", "volume", "source", "source_id")


def event_counts(events: DataFrame) -> DataFrame:
    """symbol, event_code, event_type, n of all ten types, 0 for those without events."""
    kinds = F.posexplode(F.array(*map(F.lit, EVENT_TYPES))).alias("event_code", "event_type")
    n = events.groupBy("symbol", "event_code").agg(F.count("*").alias("n"))
    return n.select("symbol").distinct().select("symbol", kinds).join(n, ["symbol", "event_code"], "left").fillna(0, ["n"])


def aligned(book: DataFrame, trades: DataFrame, rule: str = "trades_first", width: int = WIDTH) -> DataFrame:
    return merged(attributed(transitions(book, width), trades, rule, width), trades, rule)


def alignment_stats(book: DataFrame, trades: DataFrame, rule: str = "trades_first") -> DataFrame:
    """Counters of an alignment by symbol; sums of such rows are the counters of the union."""
    q = attributed(transitions(book), trades, rule)
    known = q.where("prev IS NOT NULL")
    sides = [_side("bid", 0), _side("ask", 4)]
    changed = lambda s: (F.col(f"{s}_price") != F.col(f"prev.{s}_price")) | (F.abs(F.col(f"{s}_qty") - F.col(f"prev.{s}_qty")) > EPS)
    counts = known.groupBy("symbol").agg(
        F.count("*").alias("transitions"),
        *(F.count_if(code == k).alias(EVENT_TYPES[k]) for (code, _, _), ks in zip(sides, (range(4), range(4, 8)), strict=True) for k in ks),
        (F.count_if(sides[0][2]) + F.count_if(sides[1][2])).alias("explained"),
        (F.count_if(changed("bid") & sides[0][0].isNull() & ~sides[0][2]) + F.count_if(changed("ask") & sides[1][0].isNull() & ~sides[1][2])).alias("unclassified"),
    )
    t = directions(trades).groupBy("symbol").agg(F.count_if(F.col("event_code") == BUY).alias("trade_buy"), F.count_if(F.col("event_code") == SELL).alias("trade_sell"))
    return counts.join(t, "symbol", "full").fillna(0)
