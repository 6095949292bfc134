"""What several operators of this folder share: tables, staged results, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pulseloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


FILTER = 1 << 24  # bits of a key filter, 2 MB whatever the keys


def filtered(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with the column `name`: false where (by a Bloom filter of one hash and FILTER bits) no row of keys has the
    same values of `on`, nulls equal. It is broadcast; with very many keys it is true for most rows, and only less useful."""
    word, mask = unused(rows, "own_word", "own_mask")
    place = F.xxhash64(*(F.col(f"`{c}`") for c in on)).bitwiseAND(F.lit(FILTER - 1))
    bit = lambda f, x: F.call_function(f, x, place.bitwiseAND(F.lit(63)).cast("int"))
    at = F.call_function("shiftright", place, F.lit(6))
    bits = keys.select(at.alias(word), bit("shiftleft", F.lit(1).cast("long")).alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    x = rows.withColumn(word, at).join(F.broadcast(bits), word, "left")  # FILTER / 64 rows at most
    return x.withColumn(name, F.coalesce(bit("shiftright", F.col(mask)).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop(word, mask)


HOT = 10_000  # a key with more than this part of all rows is hot; there are fewer than that


def sorted_side(df: DataFrame) -> DataFrame:
    """df with the hint to join it by sorting: each small table that is broadcast instead takes a page of tens of MB in
    every executor, and skew is split where both sides are sorted."""
    return df.hint("merge")


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with keyed, which has a row for each key and n, how many of the rows have it.

    Hot keys are fewer than HOT, so they are broadcast and their rows stay where they are. The others go through an
    exchange in which no key holds more than its part in HOT of the rows.
    """
    most = (keyed.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    hot = F.broadcast(keyed.where(F.col("n") > most))
    rest = rows.join(hot.select(keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(sorted_side(keyed.where(F.col("n") <= most)), keys))


def stars(edges: DataFrame, name: str = "cc", rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u above v, that connect what the undirected edges (a, b) connect; after enough rounds, v is the
    smallest node that u can reach. With `rounds` it stops after so many.

    Alternating large-star and small-star steps: every step is an aggregation by node and an equi-join,
    so neither links nor components ever meet in one place. Null ends and loops are ignored; without
    edges the result is empty. The edges are staged between rounds; their number and the sum of their hashes, which
    the writing itself counts, tell when nothing changes.
    """

    def written(x: DataFrame) -> tuple:
        seen = Observation()
        x = staged(x.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        return x, (seen.get["n"], seen.get["h"])

    e, before = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while before[0] and rounds != 0:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = e.select(F.col("u").alias("w"), F.col("v").alias("u"))  # from each node to those above it; the centre of a star has most
        large = up.join(sorted_side(low), "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        joined = large.join(sorted_side(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e, after = written(small.where("u <> v"))
        if after == before:
            break
        before, rounds = after, rounds and rounds - 1
    return e


def labels(star_edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of what stars() gives."""
    e = star_edges.groupBy("u").agg(F.min("v").alias("v"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(star_edges.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti").withColumn("comp", F.col("node")))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp) for the nodes of the undirected edges (a, b); comp is the smallest node reachable."""
    return labels(stars(edges, name))


def small_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """Bounds the bytes of a batch that goes to a Python worker; by rows alone, long texts would make it any size.

    A setting of the session: the registered queries and the pipeline set it, operators don't.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def kept(key: tuple, make):
    """What make() gives, kept by the worker process for its later tasks of the kind; a lost worker just makes it again."""
    store = sys.__dict__.setdefault("_pulseloom_kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


class Memory:
    """Values of words, found by `make` (from a list of words): the words of the last two generations of `size` each."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: set) -> dict:
        """A mapping that holds at least these words."""
        new = [w for w in words if w not in self.young]
        if len(self.young) + len(new) > self.size:
            self.old, self.young, new = self.young, {}, list(words)
        old = self.old
        self.young.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        self.young.update(zip(new, self.make(new), strict=True))
        return self.young


def annotate(docs: DataFrame, run, fields: str, column: str = "text", step: int = 500, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with columns that run makes of one column: run() gives a function from a list of values to a list of columns.

    fields is a DDL list. An input column that has the name of a field is replaced, those in drop are left out.
    Rows go through in slices of `step`, so a worker holds few texts at once.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    rest = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in added.names])
    passed = [i for i, c in enumerate(rest.columns) if c not in drop]
    schema = StructType([rest.schema.fields[i] for i in passed] + added.fields)
    types = [f.type for f in to_arrow_schema(added)]
    names = schema.names
    at = rest.columns.index(column)

    def mapped(batches):
        work = run()
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                made = work(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in passed), *(pa.array(x, t) for x, t in zip(made, types, strict=True))], names)

    return rest.mapInArrow(mapped, schema)
