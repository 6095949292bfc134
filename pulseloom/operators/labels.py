"""Forward-looking labels of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import QUOTE, WIDTH
from .ordered import haloed


def labels(samples: DataFrame, book: DataFrame, horizons: list[int], depletions: list[float], buffer: int = 1, width: int = WIDTH) -> DataFrame:
    """samples (symbol, tick, quote) with a_h<h> and b_x<percent>_h<h> for every horizon and depletion, as 0 or 1.

    a: some quote in [t + buffer, t + buffer + h] has a lower bid or a higher ask than the quote at t. b: there are
    quotes, all at both prices of t, and some quantity of one falls below (1 - x) of that at t. 0 without a quote at t.
    """
    q = haloed(book.select("symbol", "tick", *QUOTE), "tick", width, 0, buffer + max(horizons)).withColumn("__s", F.lit(None).cast(samples.select(F.struct("tick", "quote").alias("s")).schema["s"].dataType))
    s = samples.select("symbol", "tick", F.expr(f"floor(tick / {width})").alias("bucket"), F.struct("tick", "quote").alias("__s"))
    x = q.unionByName(s, True)
    now = {c: F.col(f"__s.quote.{c}") for c in QUOTE}
    x = x.withColumns({f"__{f}_{c}_{h}": getattr(F, f)(c).over(Window.partitionBy("symbol", "bucket").orderBy("tick").rangeBetween(buffer, buffer + h)) for h in horizons for c in QUOTE for f in ("min", "max")})
    x = x.where("__s IS NOT NULL")
    out = {}
    for h in horizons:
        low, high = (lambda c, h=h: F.col(f"__min_{c}_{h}")), (lambda c, h=h: F.col(f"__max_{c}_{h}"))
        out[f"a_h{h}"] = (low("bid_price") < now["bid_price"]) | (high("ask_price") > now["ask_price"])
        still = F.lit(True)
        for c in ("bid_price", "ask_price"):
            still = still & (low(c) == now[c]) & (high(c) == now[c])
        for x_ in depletions:
            out[f"b_x{round(100 * x_)}_h{h}"] = still & ((low("bid_qty") < now["bid_qty"] * (1.0 - x_)) | (low("ask_qty") < now["ask_qty"] * (1.0 - x_)))
    return x.select("symbol", "__s.tick", *(F.coalesce(v.cast("int"), F.lit(0)).alias(k) for k, v in out.items()))
