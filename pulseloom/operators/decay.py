"""Exponentially decayed counts of the event types, without a recursion over the stream.

Time is cut into blocks, so long that the fastest decay takes exp(600) over one. Within a block the decayed sum is a
running sum of exp(beta * (s - start)) over that of the row; what came before is the sum of earlier blocks' totals,
decayed, as far back as they weigh more than exp(-60). All decays share the blocks, so one exchange and one sort of the
events serve them all. All terms are positive, times are integers, so nothing cancels.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import UNIT

CODES = range(10)
BETAS = (0.002, 0.01, 0.05, 0.25, 1.0)  # per tick


def name_of(code: int, beta: float, mark: bool = False) -> str:
    return f"z_{'mark_' if mark else ''}event{code}_beta{beta:g}".replace(".", "p")


def scan(rows: DataFrame, betas, codes, before: bool, mark: bool = False, unit: int = UNIT) -> DataFrame:
    """rows that `keep` asks for with the decayed sums of each code and beta up to the row in the order (time, kind, seq), or before it.

    rows: symbol, time, kind, seq, event_code (null if not an event), weight, keep and others, which pass through.
    """
    size = max(1, round(600 / max(betas) * unit))
    x = rows.withColumn("__k", F.expr(f"time div {size}")).withColumn("__at", (F.col("time") - F.col("__k") * size) / unit)
    pairs = [(c, p, b) for p, b in enumerate(betas) for c in codes]
    own = {(c, p): F.when(F.col("event_code") == c, F.col("weight") * F.exp(b * F.col("__at"))) for c, p, b in pairs}
    sums = x.where("event_code IS NOT NULL").groupBy("symbol", "__k").agg(*(F.sum(own[c, p]).alias(f"__s{c}_{p}") for c, p, _ in pairs))
    steps = [F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(float(b)).alias("b")) for p, b in enumerate(betas) for n in range(1, ceil(60 * unit / (b * size)) + 2)]
    later = sums.withColumn("__l", F.explode(F.array(*steps))).withColumn("__d", F.exp(-F.col("__l.b") * F.col("__l.n") * size / unit))
    of = lambda c, p: F.sum(F.when(F.col("__l.p") == p, F.col(f"__s{c}_{p}") * F.col("__d"))).alias(f"__c{c}_{p}")
    carry = later.groupBy("symbol", (F.col("__k") + F.col("__l.n")).alias("__k")).agg(*(of(c, p) for c, p, _ in pairs))
    w = Window.partitionBy("symbol", "__k").orderBy("time", "kind", "seq").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    x = x.withColumns({f"__r{c}_{p}": F.sum(own[c, p]).over(w) for c, p, _ in pairs}).where("keep").join(carry, ["symbol", "__k"], "left")
    zero = F.lit(0.0)
    z = lambda c, p, b: (F.coalesce(F.col(f"__r{c}_{p}"), zero) + F.coalesce(F.col(f"__c{c}_{p}"), zero)) / F.exp(b * F.col("__at"))
    return x.select(*rows.columns, *(z(c, p, b).alias(name_of(c, b, mark)) for c, p, b in pairs)).drop("time", "kind", "seq", "weight", "keep")


def sampled(events: DataFrame, samples: DataFrame, betas=BETAS, codes=CODES, weight: str | None = None, unit: int = UNIT) -> DataFrame:
    """symbol, tick and the states at the samples.

    events: symbol, event_time, event_code (and a weight). An event of the sample's tick with a rank above 0 is later
    than the sample, one with rank 0 counts.
    """
    e = events.select("symbol", F.col("event_time").alias("time"), F.lit(0).alias("kind"), F.col("event_time").alias("seq"), "event_code", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), F.lit(None).cast("long").alias("tick"), F.lit(False).alias("keep"))
    s = samples.select("symbol", (F.col("tick") * unit).alias("time"), F.lit(1).alias("kind"), F.col("tick").alias("seq"), F.lit(None).cast("int").alias("event_code"), F.lit(0.0).alias("weight"), "tick", F.lit(True).alias("keep"))
    return scan(e.unionByName(s), betas, codes, False, bool(weight), unit).drop("event_code")


def before_events(events: DataFrame, betas=BETAS, codes=CODES, weight: str | None = None, time: Column | None = None, unit: int = UNIT, keep: Column | None = None) -> DataFrame:
    """events (those that `keep` asks for) with the states just before each: the event itself doesn't count, earlier
    ones of its time do. (symbol, event_time) must name an event, as it does in an aligned stream."""
    t = F.col("event_time") if time is None else time
    w = F.col(weight) if weight else F.lit(1.0)
    x = events.withColumns({"time": t.cast("long"), "kind": F.lit(0), "seq": F.col("event_time"), "weight": w.cast("double"), "keep": F.lit(True) if keep is None else keep})
    return scan(x, betas, codes, True, bool(weight), unit)


def before_events_masked(events: DataFrame, touch, betas=BETAS, codes=CODES, keep: Column | None = None) -> DataFrame:
    """before_events() on the ticks' clock, where in a tick with both a trade and a move of the touch the events of
    the other feed in the same tick don't count: touch moves for a trade, trades for a touch move."""
    trade, moved = F.col("event_code") >= 8, F.col("event_code").isin(*touch)
    tick = Window.partitionBy("symbol", "tick")
    past = tick.orderBy("event_time").rowsBetween(Window.unboundedPreceding, -1)
    both = F.max(trade).over(tick) & F.max(moved).over(tick)
    others = {c: trade if c in touch else moved for c in codes if c in touch or c >= 8}
    x = events.withColumns({f"__same{c}": F.when(both & other, F.coalesce(F.sum(F.when(F.col("event_code") == c, 1)).over(past), F.lit(0))).otherwise(0) for c, other in others.items()})
    x = before_events(x, betas, codes, None, F.col("tick"), 1, keep)
    x = x.withColumns({name_of(c, b): F.greatest(F.lit(0.0), F.col(name_of(c, b)) - F.col(f"__same{c}")) for c in others for b in betas})
    return x.drop(*(f"__same{c}" for c in others))
