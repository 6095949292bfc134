"""Reading and writing feeds as files."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .feeds import FEEDS

FILE_ROWS = 5_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in a temporary one only on a local master that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pulseloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what reads it several times doesn't make it again."""
    path, schema = shared_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df staged, with a hint to broadcast it if it has at most `most` rows."""
    x = staged(df, name)
    return F.broadcast(x) if x.count() <= most else x


@contextmanager
def tidy(spark: SparkSession):
    """Within it, shuffle files of a query go when it ends and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def has_parts(spark: SparkSession, path: str, by: str) -> bool:
    """Whether a table partitioned by a column `by` lies at path and has a partition."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return exists(spark, path) and any(x.getPath().getName().startswith(f"{by}=") for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def days(start: date, end: date) -> list[date]:
    if end < start:
        raise ValueError("end lies before start")
    return [start + timedelta(i) for i in range((end - start).days + 1)]


def items(spark: SparkSession, start: date, end: date, feeds=tuple(FEEDS), symbol: str = "S0") -> DataFrame:
    """symbol, feed and day of every file that the range needs."""
    if unknown := set(feeds) - set(FEEDS):
        raise ValueError(f"no such feed: {sorted(unknown)}")
    if end < start:
        raise ValueError(f"{end} is before {start}")
    x = spark.range(1).select(F.lit(symbol).alias("symbol"), F.explode(F.array(*map(F.lit, feeds))).alias("feed"))
    return x.withColumn("day", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("day", F.col("day").cast("string"))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a header under a declared schema; a field that doesn't fit is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with file and row, where each row lies: taken by the scan, before anything can move it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_zip(spark: SparkSession, path: str, schema: StructType, chunk: int = 50_000) -> DataFrame:
    """The CSV members of ZIP files, one task per file, streamed line by line."""
    names = schema.names

    def run(batches):
        import io

        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if bad := z.testzip():
                        raise ValueError(f"damaged member {bad}")
                    for name in z.namelist():
                        if name.endswith(".csv"):
                            with z.open(name) as f:
                                yield from (x[names] for x in pd.read_csv(f, chunksize=chunk))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def write_days(df: DataFrame, path: str, by=("symbol", "day"), rows: int | None = None) -> int:
    """Writes a partition per (symbol, day), replaces only the partitions at hand, checks the count of rows, and returns
    the number of partitions.

    The partitions are listed as they are written, in a table beside; only those are counted.
    """
    spark = df.sparkSession
    at = staged(df, "days")
    keys = staged(at.groupBy(*by).agg(F.count("*").alias("n")), "keys")
    have, total = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows is not None and total != rows:
        raise RuntimeError(f"{total} rows are at hand, {rows} expected")
    salt = F.pmod(F.xxhash64(F.struct(*at.columns)), F.ceil(F.col("n") / FILE_ROWS))  # a large day is several tasks
    spread = at.join(keys, list(by)).withColumn("__salt", salt).repartition(*by, "__salt").drop("n", "__salt")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(path)
    if (n := spark.read.schema(df.schema).parquet(path).join(keys, list(by), "left_semi").count()) != total:
        raise RuntimeError(f"{n} rows were written, {total} expected")
    return have


def write_features(df: DataFrame, path: str, labels: list[str], by=("symbol", "day")) -> DataFrame:
    """Writes a feature matrix by day, its doubles as floats, in row groups of about a hundred thousand rows; labels are
    named target_<label>. Returns what was written, also of no rows."""
    kinds = dict(df.dtypes)
    names = {c: f"target_{c}" for c in labels}
    x = df.select(*(F.col(c).cast("float").alias(c) if kinds[c] == "double" else F.col(c).alias(names.get(c, c)) for c in df.columns))
    width = 4 * len(df.columns)
    x.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.block.size", 100_000 * width).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(x.schema).parquet(path)


def convert_once(spark: SparkSession, source: str, target: str, schema: StructType, discard: bool = False) -> bool:
    """Converts CSV to Parquet unless the target is there; whether it did.

    With discard, the CSV is deleted once the table holds as many rows as it.
    """
    if exists(spark, f"{target}/_SUCCESS"):
        return False
    seen = Observation()
    read_csv(spark, source, schema).observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(target)
    if discard:
        if (n := spark.read.schema(schema).parquet(target).count()) != seen.get["n"]:
            raise RuntimeError(f"{n} rows were written, {seen.get['n']} read")
        remove(spark, source)
    return True


def read_days(spark: SparkSession, path: str, start: str, end: str, day: str = "day") -> DataFrame:
    """The partitions of the days from start to end; an error if one is missing."""
    x = spark.read.parquet(path).where(F.col(day).cast("string").between(start, end))
    have = {str(r[0]) for r in x.select(day).distinct().collect()}
    want = {str(d) for d in days(date.fromisoformat(start), date.fromisoformat(end))}
    if missing := sorted(want - have):
        raise FileNotFoundError(f"missing days: {missing}")
    return x


def time_range(events: DataFrame, start: int, end: int, trades_only: bool = False, time: str = "event_time") -> DataFrame:
    """Events of the half-open range; the filter reaches the files."""
    x = events.where((F.col(time) >= start) & (F.col(time) < end))
    return x.where("event_code >= 8") if trades_only else x


def fold_once(spark: SparkSession, path: str, make, columns: list[str]) -> DataFrame:
    """A fold's rows: read if they are at `path`, else made and written. Columns that they lack are an error."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return with_columns(spark.read.parquet(path), columns, path)


def with_columns(x: DataFrame, columns: list[str], path: str) -> DataFrame:
    """The columns of x, which was read from path; those that it lacks are an error."""
    if missing := set(columns) - set(x.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return x.select(columns)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, path: str, most: int = 10_000) -> str:
    """Writes a CSV and returns its first rows as a Markdown table."""
    df.write.mode("overwrite").option("header", True).csv(path)
    rows = df.limit(most).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in rows)])


def dump(result: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, indent=2)
