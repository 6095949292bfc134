"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_crf
from pulseloom.llm.common import new_path, small_batches, table, unused
from pulseloom.llm.queries import fold, vocabulary

MIN_SCORE = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under MIN_SCORE.

    Null, empty and blank texts are scored as one empty line, repeated rows alike; without labels or documents every
    score is 0.5. Other columns pass through whatever their names.
    """
    small_batches(spark)
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    (own,) = unused(docs, "own_quality")
    return quality_crf.score(docs, model, own).where(F.col(own) >= MIN_SCORE).drop(own)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeats of three lines; documents of which nothing is left go.

    Null and empty texts hold no lines and stay; of rows with equal doc_id and text all keep the same lines. The first
    occurrence is that of the smallest doc_id, null first. Other columns pass through whatever their names.
    """
    small_batches(spark)
    (own,) = unused(docs, "own_removed")
    return line_dedup.dedup_lines(docs, own, drop_emptied=True).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id, null last; of repeated rows one.

    Null, empty and blank texts are near copies of nothing and stay. Other columns pass through whatever their names.
    """
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark; leaves the others as they are.

    Null and empty texts hold nothing and stay; repeated rows share their fate. Items without an id or words match
    nothing. Other columns pass through whatever their names.
    """
    small_batches(spark)
    p = decontaminate.prefix_for(docs)
    x = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), prefix=p)
    return x.where(~decontaminate.contaminated(p)).select([F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, token_ids and decoded, the text that the ids decode to; a column of such a name is replaced.

    A null text counts as empty: no tokens, an empty decoded text. Every row stays.
    """
    small_batches(spark)
    return bpe.encode_and_decode(docs, vocabulary("byte_bpe_50k.json"), words=150_000)  # beside what earlier stages left in memory


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("bpe", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents that all stages before it kept. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
