"""Sizes of trades relative to those just before."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .align import WIDTH
from .ordered import haloed


def rolling_median_before(rows: DataFrame, value: str, to: str = "median", span: int = 720, width: int = WIDTH) -> DataFrame:
    """rows (symbol, tick, seq, value) with the median of the values of earlier rows, by (tick, seq), of the last
    `span` ticks; rows of the same tick that stand before count, the row itself doesn't. Null if there are none."""
    schema = StructType(list(rows.schema.fields)).add(to, "double")
    names = rows.columns

    def run(key, pdf):
        pdf = pdf.sort_values(["tick", "seq"], kind="stable").reset_index(drop=True)
        ticks, values, held, first, out = pdf["tick"].tolist(), pdf[value].tolist(), [], 0, []
        for t, v in zip(ticks, values, strict=True):
            while ticks[first] < t - span:
                del held[bisect_left(held, values[first])]
                first += 1
            n = len(held)
            out.append((held[(n - 1) // 2] + held[n // 2]) / 2 if n else None)
            insort(held, v)
        pdf[to] = out
        return pdf.loc[pdf["tick"] // width == key[1], [*names, to]]

    return haloed(rows, "tick", width, span, 0).groupBy("symbol", "bucket").applyInPandas(run, schema)


def trade_size_marks(trades: DataFrame, span: int = 720) -> DataFrame:
    """trades (symbol, tick, id, qty) with mark: qty over the rolling median before; 1 where that is missing or not positive."""
    x = rolling_median_before(trades.withColumn("seq", F.col("id")), "qty", "median", span)
    return x.withColumn("mark", F.when(F.col("median") > 0, F.col("qty") / F.col("median")).otherwise(1.0)).drop("seq")
