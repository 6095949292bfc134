"""Features on a regular grid of samples: the book's state, order-flow imbalance, ranks, seasonality."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .align import QUOTE, WIDTH
from .ordered import bucket_of, haloed, last_known, previous


def grid(book: DataFrame, step: int = 10, lead: int = 11, width: int = WIDTH) -> DataFrame:
    """symbol and tick of the samples: multiples of step from the first quote to `lead` ticks before the last."""
    b = book.groupBy("symbol").agg(F.expr(f"ceil(min(tick) / {step}) * {step}").alias("a"), F.expr(f"floor((max(tick) - {lead}) / {step}) * {step}").alias("z")).where("a <= z")
    b = b.select("symbol", "a", "z", F.explode(F.sequence(F.expr(f"floor(a / {width})"), F.expr(f"floor(z / {width})"))).alias("k"))
    b = b.select("symbol", F.expr(f"greatest(a, ceil(k * {width} / {step}) * {step})").alias("a"), F.expr(f"least(z, floor(((k + 1) * {width} - 1) / {step}) * {step})").alias("z")).where("a <= z")
    return b.select("symbol", F.explode(F.sequence("a", "z", F.lit(step).cast("long"))).alias("tick"))


def as_of(samples: DataFrame, book: DataFrame, to: str = "quote", shift: int = 0, width: int = WIDTH) -> DataFrame:
    """samples with the last quote at or before tick + shift (a struct of tick, update_id and the state); of equal ticks the last."""
    keep = [c for c in samples.columns if c != "symbol"]
    q = book.select("symbol", "tick", F.lit(0).alias("kind"), "update_id", F.struct("tick", "update_id", *QUOTE).alias("q"))
    s = samples.select("symbol", (F.col("tick") + shift).alias("tick"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("update_id"), F.struct(*keep).alias("__s"))
    x = last_known(q.unionByName(s, True), ["symbol"], ["tick", "kind", "update_id"], "q", to, bucket_of("tick", width))
    return x.where("__s IS NOT NULL").select("symbol", "__s.*", to)


def next_quotes(samples: DataFrame, book: DataFrame, strict: bool = False, width: int = WIDTH) -> DataFrame:
    """samples with next, the first quote at or after their tick (after it, if strict)."""
    keep = [c for c in samples.columns if c != "symbol"]
    q = book.select("symbol", "tick", F.lit(0 if strict else 1).alias("kind"), "update_id", F.struct("tick", "update_id").alias("q"))
    s = samples.select("symbol", "tick", F.lit(1 if strict else 0).alias("kind"), F.lit(0).cast("long").alias("update_id"), F.struct(*keep).alias("__s"))
    x = last_known(q.unionByName(s, True), ["symbol"], ["tick", "kind", "update_id"], "q", "next", bucket_of("tick", width), backward=True)
    return x.where("__s IS NOT NULL").select("symbol", "__s.*", "next")


def micro_price(q: str = "quote") -> dict[str, Column]:
    """spread, and the micro-price's distance from the middle."""
    bp, bq, ap, aq = (F.col(f"{q}.{c}") for c in QUOTE)
    return {"spread": ap - bp, "micro_minus_mid": (ap * bq + bp * aq) / F.greatest(bq + aq, F.lit(1e-12)) - (ap + bp) / 2}


def order_flow(samples: DataFrame, width: int = WIDTH) -> DataFrame:
    """samples (with quote) with ofi, the order-flow imbalance against the sample before; 0 for the first."""
    x = previous(samples, ["symbol"], ["tick"], ["quote"], "__p", bucket_of("tick", width))
    now, was = (lambda c: F.col(f"quote.{c}")), (lambda c: F.col(f"__p.quote.{c}"))
    on = lambda cond, v: F.when(cond, v).otherwise(0.0)
    ofi = (
        on(now("bid_price") >= was("bid_price"), now("bid_qty")) - on(now("bid_price") <= was("bid_price"), was("bid_qty"))
        - on(now("ask_price") <= was("ask_price"), now("ask_qty")) + on(now("ask_price") >= was("ask_price"), was("ask_qty"))
    )
    return x.withColumn("ofi", F.when(F.col("__p").isNull(), 0.0).otherwise(ofi)).drop("__p")


def rolling_rank(samples: DataFrame, values: list[str], active: str, span: int = 720, width: int = WIDTH) -> DataFrame:
    """samples with v_rank for each v of values and active_count.

    The rank is the share of active rows of the last `span` ticks, the row included, whose value is at most the
    row's; rows that aren't active have rank 1 and count nowhere. Each bucket's task gets its rows and those of
    one span before, and holds them sorted.
    """
    schema = StructType(list(samples.schema.fields))
    for v in values:
        schema = schema.add(f"{v}_rank", "double")
    schema = schema.add("active_count", "long")
    names = samples.columns

    def run(key, pdf):
        pdf = pdf.sort_values("tick", kind="stable").reset_index(drop=True)
        ticks, on = pdf["tick"].tolist(), pdf[active].tolist()
        first, ranks, counts = 0, {v: [1.0] * len(pdf) for v in values}, [0] * len(pdf)
        held = {v: [] for v in values}
        data = {v: pdf[v].tolist() for v in values}
        n = 0
        for i, t in enumerate(ticks):
            while ticks[first] < t - span:
                if on[first]:
                    n -= 1
                    for v in values:
                        h = held[v]
                        del h[bisect_left(h, data[v][first])]
                first += 1
            if on[i]:
                n += 1
                for v in values:
                    insort(held[v], data[v][i])
                    ranks[v][i] = bisect_right(held[v], data[v][i]) / n
            counts[i] = n
        for v in values:
            pdf[f"{v}_rank"] = ranks[v]
        pdf["active_count"] = counts
        own = pdf["tick"] // width == key[1]
        return pdf.loc[own, [*names, *(f"{v}_rank" for v in values), "active_count"]]

    return haloed(samples, "tick", width, span, 0).groupBy("symbol", "bucket").applyInPandas(run, schema)


def l1_features(book: DataFrame, step: int = 10, lead: int = 3, max_age: int = 100, span: int = 720, width: int = WIDTH) -> DataFrame:
    """Features of the valid samples: symbol, tick, ofi, micro_minus_mid, spread, bid_qty, ask_qty, their ranks.

    Valid: a quote no older than max_age at the sample and `lead` ticks later, one span since the first quote,
    and as many active rows in the span as it has samples, 60 at most.
    """
    first = book.groupBy("symbol").agg(F.min("tick").alias("first"))
    s = as_of(grid(book, step, lead, width), book, "quote", 0, width)
    s = as_of(s, book, "later", lead, width)
    s = order_flow(s, width)
    m = micro_price()
    s = s.select(
        "symbol", "tick", "ofi", m["micro_minus_mid"].alias("micro_minus_mid"), m["spread"].alias("spread"), F.col("quote.bid_qty").alias("bid_qty"), F.col("quote.ask_qty").alias("ask_qty"),
        F.coalesce(F.col("tick") - F.col("quote.tick") <= max_age, F.lit(False)).alias("active"), F.coalesce(F.col("tick") + lead - F.col("later.tick") <= max_age, F.lit(False)).alias("fresh"),
    )
    s = rolling_rank(s, ["bid_qty", "ask_qty"], "active", span, width).join(first, "symbol")
    s = s.where((F.col("active")) & (F.col("fresh")) & (F.col("tick") >= F.col("first") + span) & (F.col("active_count") >= min(60, span // step)))
    return s.select("symbol", "tick", "ofi", "micro_minus_mid", "spread", "bid_qty", "ask_qty", "bid_qty_rank", "ask_qty_rank")


def seasonality(seconds: Column) -> dict[str, Column]:
    """16 daily harmonics and 6 indicators of the five minutes before and after 00, 08 and 16 h; `seconds` since the epoch."""
    s = F.pmod(seconds, F.lit(86_400))
    out = {}
    for k in range(1, 9):
        angle = 2 * F.pi() * k * s / 86_400
        out |= {f"cos_{k}": F.cos(angle), f"sin_{k}": F.sin(angle)}
    for h in (0, 8, 16):
        d = F.pmod(s - h * 3600 + 43_200, F.lit(86_400)) - 43_200
        out |= {f"before_{h:02d}": ((d >= -300) & (d < 0)).cast("double"), f"after_{h:02d}": ((d >= 0) & (d <= 300)).cast("double")}
    return out


def seasonal_rate(design: dict[str, Column], eta: float, harmonic: list[float], funding: list[float], eps: float = 1e-9) -> Column:
    """Intensity of a positive harmonic baseline times the effect of the indicators."""
    from math import exp, sqrt

    names = list(design)
    amplitude = sum(sqrt(a * a + b * b + eps) for a, b in zip(harmonic[::2], harmonic[1::2], strict=True))
    wave = sum((design[n] * w for n, w in zip(names[:16], harmonic, strict=True)), F.lit(eps + exp(eta) + amplitude))
    tilt = sum((design[n] * w for n, w in zip(names[16:], funding, strict=True)), F.lit(0.0))
    return F.greatest(wave * F.exp(F.least(F.lit(20.0), F.greatest(F.lit(-20.0), tilt))), F.lit(eps))
