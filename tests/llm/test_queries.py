"""Registered queries and the pipeline over whole small tables, against the library or plain Python."""

import hashlib
import re
import zlib

import pytest

pytest.importorskip("pulseloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
import numpy as np
from pulseloom.llm import decontaminate, html_extract, language_id, line_dedup, near_dedup, quality_crf, quality_rules, queries, token_files
from pulseloom.llm.common import filtered, new_path, spread_join
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
LITTLE = "/root/testdata/sf0.001"
LINE_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark, sf=SF):
    return sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))


def little_endian(ids):
    return np.array(ids, "<u4").tobytes()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def near_words(text):
    return re.findall(LINE_SPACE + "+", lower(text))


def contamination(docs, items, window=13):
    """By doc_id: number of words, of hit words, and the sorted items."""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= k
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def test_token_files_hold_what_the_library_gives(spark):
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = sorted(map(tuple, queries.op6_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for doc, text in documents(spark):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(little_endian(ids))))
        at += len(ids)
    assert got == want


def rows_of_scan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files_are_skipped_by_index_and_bloom_filter(spark):
    """Stripes and their row groups have minima and maxima; a missing odd id within them only the Bloom filter rules out."""
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("words of number "), F.col("id").cast("string")).alias("text"))
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs.coalesce(1), path, queries.vocabulary("word_bpe_49k.json"), 2, stripe_bytes=64 << 10, stride=1000)
    x = spark.read.schema("doc_id long, n_tokens long").orc(path)
    assert x.count() == 20_000
    assert rows_of_scan(x.where("doc_id BETWEEN 8000 AND 8100")) < 8000
    assert 1 <= rows_of_scan(x.where("doc_id = 8000")) < 8000
    assert sum(rows_of_scan(x.where(f"doc_id = {2 * k + 1}")) > 0 for k in range(100, 19_000, 950)) <= 3


def test_one_doc_id_of_many_rows_is_several_files(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the rows were many
    try:
        token_files.write_tokens(docs, path, queries.vocabulary("word_bpe_49k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_tokens(spark, path).select("start", "n_tokens").collect()
    assert len(got) == 3000 and spark.read.orc(path).select(F.input_file_name()).distinct().count() > 1
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_decontamination_against_plain_windows(spark):
    want = contamination(documents(spark), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    got = queries.op7_decontaminate(spark, SF).collect()
    assert len(got) == len(want) and sum(r["contaminated"] for r in got) > 0
    for r in got:
        n, hit, items = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_bpe_query_against_the_library(spark):
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF).collect()}
    for doc, text in documents(spark):
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got.pop(doc)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(little_endian(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def sets_of(docs, k):
    out = {}
    for doc, text in docs:
        w = near_words(text)
        out[doc] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def linked(sets, percent):
    """The smallest doc_id that each can reach, from all pairs that share a shingle."""
    where, comp = {}, {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for d in sorted(sets):
        both = {}
        for s in sets[d]:
            for o in where.setdefault(s, []):
                both[o] = both.get(o, 0) + 1
            where[s].append(d)
        for o, n in both.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                comp[b] = a
    return {d: root(d) for d in sets}


def test_near_duplicates_against_all_pairs(spark):
    sets = sets_of(documents(spark), 3)
    want = linked(sets, 85)
    got = {r["doc_id"]: r for r in queries.op1_near_dedup(spark, SF).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_a_host_is_vetoed(spark):
    """A good document goes with its host where most others fail; a small host is pulled to the rate of all."""
    good, bad = " ".join(f"word{i}" for i in range(60)), "short"
    rows = [(0, good, "bad host")] + [(100 + i, bad, "bad host") for i in range(40)]
    rows += [(1000 + i, good, f"host {i % 8}") for i in range(160)] + [(2000, good, None)] + [(2001 + i, bad, None) for i in range(30)]
    rows += [(3000, bad, "tiny"), (3001, good, "tiny"), (4000, good, "")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0]["base_failed"] and got[0]["host_rate"] > 0.5 and not got[0]["kept"]
    assert not got[2000]["kept"], "rows without a host are one host"
    assert got[4000]["kept"] and got[4000]["host_rate"] != got[2000]["host_rate"], "an empty name is another"
    assert all(got[1000 + i]["kept"] for i in range(160))
    hosts = {}
    for d, t, h in rows:
        hosts.setdefault(h, []).append(t == bad)
    rates = [np.mean(v) for v in hosts.values()]
    m, v = np.mean(rates), np.var(rates, ddof=1)
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1))
    for d, _, h in rows:
        assert got[d]["host_rate"] == pytest.approx((sum(hosts[h]) + s * m) / (len(hosts[h]) + s))
    assert got[3001]["host_rate"] == pytest.approx((1 + s * m) / (2 + s)) != 0.5


def cut_lines(docs):
    seen, gone, solid = {}, {}, {}
    for doc, text in docs:
        lines = text.split("\n")
        at = solid[doc] = [i for i, x in enumerate(lines) if re.search(LINE_SPACE, x)]
        for j in range(len(at) - 2):
            w = tuple(lines[i] for i in at[j : j + 3])
            if seen.setdefault(w, (doc, j)) != (doc, j):
                gone.setdefault(doc, set()).update(at[j : j + 3])
    out = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in docs]
    return [(d, t) for d, t in out if d not in gone or re.search(LINE_SPACE, t)]


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{LITTLE}/documents.parquet")
    model = quality_crf.learn(docs, spark.read.parquet(f"{LITTLE}/labels.parquet"), queries.fold(5) != 0)
    rows = [(d, t) for d, t in documents(spark, LITTLE) if t is not None]
    good = [quality_crf.features_of(t) for _, t in rows]
    g = quality_crf.logit(quality_crf.goodness([f for f, _ in good], [n for _, n in good], model))
    left = [r for r, x in zip(rows, g, strict=True) if 1 / (1 + np.exp(-(model["a"] * x + model["b"]))) >= corpus_pipeline.MIN_SCORE]
    assert len(left) < len(rows)
    left = cut_lines(left)
    comp = linked(sets_of(left, 5), 80)
    left = [(d, t) for d, t in left if comp[d] == d]
    hits = contamination(left, [tuple(r) for r in spark.read.parquet(f"{LITTLE}/benchmark.parquet").select("item_id", "text").collect()])
    left = [(d, t) for d, t in left if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, LITTLE)
    assert out.columns == [*docs.columns, "n_tokens", "token_ids", "decoded"]
    got = sorted((r["doc_id"], r["text"], r["n_tokens"], bytes(r["token_ids"]), r["decoded"]) for r in out.collect())
    assert got == [(d, t, len(ids), little_endian(ids), t) for d, t in left for ids in [library.encode(t, add_special_tokens=False).ids]]


def test_joins_with_hot_and_rare_keys(spark, monkeypatch):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k % 2 = 0")
    monkeypatch.setattr("pulseloom.llm.common.HOT", 10)
    got = spread_join(rows, keyed, ["k"])
    assert sorted(map(tuple, got.select("id", "k", "low").collect())) == sorted(map(tuple, rows.join(keyed, "k").select("id", "k", "low").collect()))
    near = filtered(rows, rows.where("id IN (3, 4, 4999)").select(F.col("k").alias("id")), ["id"], "maybe")
    assert {r["id"] for r in near.where("maybe").collect()} >= {0, 4, 4999} and near.where("maybe").count() < 50


def test_learning_is_bounded_in_lines(spark):
    docs = spark.createDataFrame([(i, "a line\n" * (5 if i else 400)) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fit = quality_crf.fit
    quality_crf.fit = lambda f, n, y: seen.append(sum(map(len, f))) or fit(f, n, y)
    try:
        quality_crf.learn(docs, labels, F.lit(True), most_lines=100)
        quality_crf.learn(docs, labels, F.lit(True))
    finally:
        quality_crf.fit = fit
    assert 50 < seen[0] <= 100 and seen[1] == 39 * 5 + 400


def test_very_many_lines(spark):
    """Whole long texts in the operators that go by lines, turns of phrase or tags."""
    text = "\n".join(f"line {i % 700} of {i % 11} and more" for i in range(30_000))
    docs = spark.createDataFrame([(1, text, "h"), (2, text, "h"), (3, "\n" * 50_000, "h")], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: 30_000 - 7700, 2: 30_000, 3: 0}
    model = quality_crf.learn(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"), F.lit(True))
    assert quality_crf.score(docs, model).count() == 3
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.quality_rules(docs).collect()} == {1: 30_000 - 7700, 2: 30_000 - 7700, 3: 0}
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1, 3}
    assert language_id.identify(docs, {"langs": [], "grams": {}, "scripts": {}}).count() == 3
    assert len(html_extract.main_text("<p>" + text.replace("\n", "<br>"))) == len(text)
    assert decontaminate.find_items(docs, spark.createDataFrame([(1, "line 3 of 3 and more")], "item_id long, text string")).where("n_hit > 0").count() == 2
