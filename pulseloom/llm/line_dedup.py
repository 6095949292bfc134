"""Line deduplication with windows of three consecutive lines, in DataFrame functions only.

Lines that hold more than white space are numbered within a document; every three in a row make a window with a
128-bit hash. Windows that occur twice or more keep their first occurrence, by doc_id and place. The lines of all
later occurrences go; overlapping ones are merged by taking the union of the lines they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered, spread_join, staged, unused

SPAN = 3


def let(value: Column, then) -> Column:
    """then(value), with value computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def windows(docs: DataFrame) -> DataFrame:
    """d, t (doc_id and hash of the text), j (number of the first line), h1, h2 of every window."""
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"\S"))

    def hashes(x: Column) -> Column:
        at = lambda j, k: F.get(x, j + k)
        one = lambda j: F.struct(j.alias("j"), F.xxhash64(at(j, 0), at(j, 1), at(j, 2)).alias("h1"), F.xxhash64(F.lit(3), at(j, 2), at(j, 0), at(j, 1)).alias("h2"))
        return F.when(F.size(x) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(x) - SPAN), one))

    x = docs.where(F.col("text").isNotNull())
    return x.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.inline(let(lines, hashes)))


def later_windows(docs: DataFrame) -> DataFrame:
    """d, t and j of the windows that occurred before."""
    w = staged(windows(docs), "windows")
    firsts = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "j")).alias("first")).where("n > 1")
    again = spread_join(w, staged(firsts, "firsts"), ["h1", "h2"])
    return again.where(~F.struct("d", "t", "j").eqNullSafe(F.col("first"))).select("d", "t", "j")


def dedup_lines(docs: DataFrame, count: str = "n_removed", drop_emptied: bool = False) -> DataFrame:
    """docs with later repeats cut from text, and how many lines each row lost (column `count`).

    Blank lines are no part of windows and stay; documents with fewer than three other lines stay whole. The
    first occurrence is that of the smallest doc_id (null first), then of the text's hash, then of the place.
    Rows with equal doc_id and text are one document: all keep the same lines. Null texts stay null. A text
    that loses every line becomes empty; drop_emptied drops such rows. Other columns pass through whatever
    their names, one named like the count is replaced. An empty table gives an empty result.
    """
    cover = staged(later_windows(docs).groupBy("d", "t").agg(F.collect_set("j").alias("js")), "cover")  # at most a document's lines
    x = docs.drop(count)
    d, t, u, js, text, n, maybe = unused(x, "own_d", "own_t", "own_u", "own_js", "own_text", "own_n", "own_maybe")
    x = filtered(x.withColumn(t, F.xxhash64("text")), cover.select(F.col("d").alias("doc_id"), F.col("t").alias(t)), ["doc_id", t], maybe)
    cover = cover.select(F.col("d").alias(d), F.col("t").alias(u), F.col("js").alias(js))
    hit = x.where(maybe).join(cover, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(u)), "left")
    x = hit.drop(d, u).unionByName(x.where(~F.col(maybe)).withColumn(js, F.lit(None).cast("array<int>")))  # most rows lose nothing and stay where they are
    solid = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\S"))
    covered = lambda places: F.array_distinct(F.flatten(F.transform(js, lambda j: F.slice(places, j + 1, SPAN))))
    without = lambda lines, gone: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    new = let(F.split("text", "\n", -1), lambda lines: let(solid(lines), lambda places: let(covered(places), lambda gone: F.struct(without(lines, gone).alias("text"), F.size(gone).alias("n")))))
    result = F.when(F.col(js).isNull(), F.struct("text", F.lit(0).alias("n"))).otherwise(new)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", count)]
    x = x.select(*others, js, F.inline(F.array(result)).alias(text, n))  # made once per row
    if drop_emptied:
        x = x.where(F.col(js).isNull() | F.col(text).rlike(r"\S"))
    return x.select(*[F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != count], F.col(n).cast("long").alias(count))


SQL = r"""
WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, r, line AS a, lead(line) OVER p AS b, lead(line, 2) OVER p AS c FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY r)),
o AS (SELECT doc_id, r, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, r) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, q AS r FROM (SELECT doc_id, unnest([r, r + 1, r + 2]) AS q FROM o WHERE k > 1)),
gi AS (SELECT s.doc_id, s.i FROM s JOIN g USING (doc_id, r)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gi USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gi GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
