"""Quality rules of documents and of their hosts.

Each document is counted in one pass. Rule failures are then summed by host, each host's failure rate is
shrunk towards the rate of all hosts with a beta prior fitted to them by moments, and hosts whose shrunk
rate is too high lose all their documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, spread_join, staged

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    two = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)[1].ravel()
    _, which, n = np.unique(two * np.int64(len(ids)) + a[2:], return_inverse=True, return_counts=True)
    again = n[which.ravel()] > 1
    hit = np.zeros(len(a), bool)
    for i in range(3):
        hit[i : i + len(again)] |= again
    return int(hit.sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # of bytes: at ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(words), len(text) - (len(raw) - len(raw.translate(None, SPACES))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs without text and with the five counts of it, all 0 for a null or empty text; a column of such a name is replaced."""
    return annotate(docs, lambda: lambda texts: list(zip(*map(counts_of, texts), strict=True)) or [[]] * 5, COUNTS, drop=("text",))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, repeat_percent: int = 50, max_rate: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, host_rate (shrunk) and kept for every row of docs (doc_id, text, host).

    A document fails if it has fewer than min_words words or more than repeat_percent % repeated ones. A host's
    rate is (failures + s * m) / (documents + s); m is the mean failure rate of hosts and s = m(1-m)/v - 1 for
    their variance v, held between 1 and 1000 (1000 if v is 0 or there is one host). Null hosts are one host.
    kept: it did not fail and its host's rate is at most max_rate. A null text counts as empty and fails. Repeated
    rows count each time; an empty table gives an empty result.
    """
    x = base_counts(docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), "text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    x = staged(x.withColumn("base_failed", failed), "rules")
    x = x.withColumns({"h": F.coalesce("host", F.lit("")), "no": F.col("host").isNull()})
    hosts = staged(x.groupBy("h", "no").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("int")).alias("f")), "hosts")
    m, v = hosts.agg(F.avg(F.col("f") / F.col("n")), F.var_samp(F.col("f") / F.col("n"))).first()
    m = m or 0.0
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
    hosts = hosts.select("h", "no", "n", ((F.col("f") + s * m) / (F.col("n") + s)).alias("host_rate"))
    out = spread_join(x, hosts, ["h", "no"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
m AS (SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (k + s * m) / (n + s) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, s
"""
