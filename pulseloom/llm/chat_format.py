"""Chat formatting of logged conversations, in DataFrame functions only.

Logs hold a conversation again each time it grows. A rolling hash over the turns names every prefix of every
conversation; a conversation whose whole hash names a proper prefix of another is an earlier snapshot, and an
anti-join drops it. Of equal conversations the smallest conv_id stays. What is left is rendered.

The hash of a prefix is the exclusive or of its turns' hashes, each taken with the turn's place, so a running
window makes it in one pass over a conversation's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KEY = ["k1", "k2"]


def hashed(seed: int) -> Column:
    """The hash of a turn at place i."""
    return F.xxhash64(F.lit(seed), "i", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, i, k1, k2 (hash of the first i turns) and ends (whether they are all), without the texts.

    One exchange and one sort by conversation serve all windows; rows that are equal stand side by side in them.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    x = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    x = x.withColumn("was", F.lag(F.struct("turn", "role", "text")).over(order)).where(~F.col("was").eqNullSafe(F.struct("turn", "role", "text")))
    x = x.withColumns({"i": F.row_number().over(order), "ends": F.lead(F.lit(False), 1, True).over(order)})
    x = x.select("conv_id", "i", "ends", *(F.bit_xor(hashed(s)).over(so_far).alias(k) for s, k in enumerate(KEY, 1)))
    return x.unionByName(lone(conversations).select(F.lit(None).cast(x.schema["conv_id"].dataType).alias("conv_id"), "i", F.lit(True).alias("ends"), *KEY))


def lone(conversations: DataFrame) -> DataFrame:
    """role, text, i and hash of the rows without a conv_id."""
    x = conversations.where(F.col("conv_id").isNull()).select("role", "text").distinct().withColumn("i", F.lit(1))
    return x.withColumns({k: hashed(s) for s, k in enumerate(KEY, 1)})


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, k1 and k2 (hash of all turns) of the conversations that are no snapshot of another."""
    x = staged(prefixes(conversations), "prefixes")
    grown = x.where("NOT ends").select(*KEY).distinct()
    return x.where("ends").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id")).join(grown, KEY, "left_anti")


def format_chats(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns and text of every maximal conversation of (conv_id, turn, role, text).

    Turns are ordered by turn, role, text, nulls first; rows equal in all of these count once. A conversation is
    dropped if the roles and texts of its turns are the first turns of a longer one; of equal ones the smallest
    conv_id stays. A row with a null conv_id is a conversation of its own, of one turn, that any equal one with a
    conv_id stands for. A turn is rendered as start + role + newline + text + end + newline, nulls as empty. An
    empty table gives an empty result. Other columns are ignored.
    """
    kept = maximal(conversations)
    turn = lambda role, text: F.concat(F.lit(start), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(end + "\n"))
    rows = conversations.select("conv_id", "turn", "role", "text").join(kept.where(F.col("conv_id").isNotNull()).select("conv_id"), "conv_id")
    named = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))  # a conversation is one document
    named = named.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda s: turn(s["role"], s["text"])), "").alias("text"))
    others = lone(conversations).join(kept.where(F.col("conv_id").isNull()), KEY)
    return named.unionByName(others.select("conv_id", F.lit(1).cast("long").alias("n_turns"), turn(F.col("role"), F.col("text")).alias("text")))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t WHERE conv_id IS NOT NULL UNION ALL SELECT DISTINCT NULL, NULL, role, text, 1 FROM t WHERE conv_id IS NULL),
e AS (SELECT *, coalesce('c' || conv_id, 'n' || row_number() OVER ()) AS c, md5(CASE WHEN role IS NULL THEN 'n' ELSE 'v' || role END || chr(1) || CASE WHEN text IS NULL THEN 'n' ELSE 'v' || text END) AS h FROM r),
p AS (SELECT c, conv_id, i, string_agg(h, '') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY c) AS n FROM e),
f AS (SELECT c, conv_id, k FROM p WHERE i = n),
m AS (SELECT arg_min(c, coalesce(conv_id, 9223372036854775807)) AS c FROM f WHERE k NOT IN (SELECT k FROM p WHERE i < n) GROUP BY k)
SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM e JOIN m USING (c) GROUP BY c, conv_id
"""
