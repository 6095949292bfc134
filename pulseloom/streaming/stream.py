"""Streams of aligned events: counts, and decayed states with state per symbol. Beyond batch, an extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.align import UNIT
from ..operators.decay import CODES, name_of

EVENTS = "symbol string, event_time long, event_code int"


def read(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run(query_of: DataFrame, mode: str, state: str, out: str) -> None:
    """Runs over what is there, and ends; each batch goes to files, written again if it is repeated."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query_of.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def counts(spark: SparkSession, path: str, state: str) -> DataFrame:
    """symbol, event_code, n over the whole stream: the last update of each key."""
    x = read(spark, path, 100).groupBy("symbol", "event_code").agg(F.count("*").alias("n"))
    run(x, "update", f"{state}/state", f"{state}/out")
    done = spark.read.schema("symbol string, event_code int, n long").parquet(f"{state}/out/*")
    return done.groupBy("symbol", "event_code").agg(F.max("n").alias("n"))


def windowed(spark: SparkSession, path: str, minutes: int, late: str, tick_seconds: int = 60) -> DataFrame:
    """A stream of symbol, window, event_code, n, final once the watermark has passed a window."""
    at = F.timestamp_seconds(F.col("event_time") / UNIT * tick_seconds).alias("at")
    x = read(spark, path).select("symbol", "event_code", at).withWatermark("at", late)
    return x.groupBy("symbol", F.window("at", f"{minutes} minutes"), "event_code").agg(F.count("*").alias("n"))


def states(spark: SparkSession, path: str, state: str, beta: float) -> DataFrame:
    """symbol, event_time of its last event, and the decayed count of each code then. A symbol's state is ten numbers and
    a time; an event older than the time decays to it before it is added, so the order of arrival doesn't matter."""
    names = [name_of(c, beta) for c in CODES]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, *rest = held.get if held.exists else (-1, *[0.0] * len(names))
        z = np.array(rest)
        for b in batches:
            t, c = b["event_time"].to_numpy(), b["event_code"].to_numpy()
            new = max(int(t.max()), last)
            if last >= 0:
                z *= np.exp(-beta * (new - last) / UNIT)
            np.add.at(z, c, np.exp(-beta * (new - t) / UNIT))
            last = new
        held.update((last, *map(float, z)))
        yield pd.DataFrame([(key[0], last, *z)], columns=["symbol", "event_time", *names])

    kinds = ", ".join(f"{n} double" for n in names)
    x = read(spark, path, 100).groupBy("symbol").applyInPandasWithState(step, f"symbol string, event_time long, {kinds}", f"last long, {kinds}", "update", GroupStateTimeout.NoTimeout)
    run(x, "update", f"{state}/state", f"{state}/out")
    done = spark.read.schema(f"symbol string, event_time long, {kinds}, batch int").parquet(f"{state}/out/*")
    last = done.groupBy("symbol").agg(F.max(F.struct("event_time", "batch", *names)).alias("s"))
    return last.select("symbol", "s.event_time", *(f"s.{n}" for n in names))
