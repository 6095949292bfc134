"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

pytest.importorskip("pulseloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from pulseloom.llm import bpe, chat_format, decontaminate, html_extract, language_id, line_dedup, near_dedup, quality_crf, quality_rules, token_files
from pulseloom.llm.common import components, new_path
from pulseloom.llm.queries import vocabulary
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 9973}x{i % 61}" for i in range(120_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog\nand then it rests\nfor a while\nin the shade", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "b", 4),
    (None, "a text without a name that nobody asked for but which is here", "en", None, 9),
    (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)),
    (6, "the quick brown fox jumps over the lazy dog\nand then it rests\nfor a while\nin the shade", "en", "a", 1),
    (6, "the quick brown fox jumps over the lazy dog\nand then it rests\nfor a while\nin the shade", "en", "a", 1),
    (7, "ÜberİΣ \x1c   é <|endoftext|> 12345 !!", "de", "c", 5),
]
#: Also names that operators use inside.
CLASH = ["kept", "score", "node", "comp", "cid", "n_words", "ids", "rk", "part", "h1", "d", "t", "j", "host", "component_id", "__rk2", "own_d", "own_t", "own_u", "own_js", "own_text", "own_n", "own_r", "own_rk", "own_cut", "hit_hits", "Hit_Items", "own_quality", "own_removed", "__js", "__d", "__n", "__t", "__cut", "__hit_n_words", "__quality", "sig", "low", "h", "n", "m", "top", "tree", "other", "own"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit("own " + c).alias(c) for c in CLASH))


def passed(out, *but):
    """Whether every row of out still has the values of the clashing columns."""
    names = [c for c in CLASH if c in out.columns and c not in but]
    return len(names) > 40 and out.where(" OR ".join(f"`{c}` <> 'own {c}' OR `{c}` IS NULL" for c in names)).count() == 0


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_near_duplicates(spark, docs, wide):
    out = near_dedup.near_duplicates(docs, 3, 0.85)
    got = rows(out, "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == len(ROWS)
    assert (6, 17, 1, False) in got and (1, 17, 1, True) in got
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert (None, 0, None, True) in got
    assert rows(near_dedup.near_duplicates(wide, 3, 0.85), "doc_id", "component_id", "kept") == rows(out, "doc_id", "component_id", "kept")
    assert near_dedup.near_duplicates(docs.limit(0), 3, 0.85).count() == 0


def test_one_of_each(docs, wide):
    out = near_dedup.one_of_each(wide)
    assert out.columns == wide.columns and passed(out)
    assert [r[0] for r in rows(out, "doc_id")].count(6) == 0
    assert {r[0] for r in rows(out, "doc_id")} == {1, 2, 3, 4, 5, 7, None}
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 6")
    assert near_dedup.one_of_each(twice).count() == 1


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (None, 2)], "a int, b int")
    assert {r["node"]: r["comp"] for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert components(e.limit(0)).count() == 0


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, n int"
    data = [(1, 0, "user", "hi", 1), (2, 0, "user", "hi", 1), (2, 1, "assistant", "yes", 1), (3, 0, "user", "hi", 1), (3, 1, "assistant", "yes", 1), (4, None, None, None, None), (None, 0, "user", "lone", 1), (5, 0, "user", "twice", 1), (5, 0, "user", "twice", 1), (6, 0, "user", "hi", 1), (6, 1, "assistant", "yes", 1), (6, 2, "user", "", 1)]
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat_format.format_chats(spark.createDataFrame(data, kind)).collect()}
    assert got == {4: (1, "<|im_start|>\n<|im_end|>\n"), None: (1, "<|im_start|>user\nlone<|im_end|>\n"), 5: (1, "<|im_start|>user\ntwice<|im_end|>\n"), 6: (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n")}
    alone = spark.createDataFrame([(None, 3, "user", "x", 1), (None, 4, "user", "x", 1), (None, 0, "user", "y", 1), (9, 0, "user", "x", 1), (9, 1, "user", "z", 1)], kind)
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["text"][17:18]) for r in chat_format.format_chats(alone).collect()) == [(0, 1, "y"), (9, 2, "x")]
    long = spark.range(3000).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "CAST(id AS STRING) AS text", "1 AS n").where("conv_id = 0 OR turn < 2000")
    assert {r["conv_id"]: r["n_turns"] for r in chat_format.format_chats(long).collect()} == {0: 1500, 1: 1000}
    equal = spark.createDataFrame([(8, 0, "user", "x", 1), (7, 0, "user", "x", 1), (None, 0, "user", "x", 1)], kind)
    assert [r["conv_id"] for r in chat_format.format_chats(equal).collect()] == [7]
    assert chat_format.format_chats(equal.limit(0)).count() == 0


def test_language(spark, docs, wide):
    model = language_id.learn(docs, F.lit(True))
    out = rows(language_id.identify(wide, model), "doc_id", "lang_pred", "score")
    assert len(out) == len(ROWS)
    assert (2, "und", 0.0) in out and (3, "und", 0.0) in out and (4, "und", 0.0) in out
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.learn(docs.where("lang is null"), F.lit(True))
    assert {r[0] for r in rows(language_id.identify(docs, none), "lang_pred")} == {"und"}


def test_language_spans(spark):
    train = [(i, "the and with this that from which " * 5, "en", "", 0) for i in range(5)] + [(i + 9, "der die und nicht auch eine über " * 5, "de", "", 0) for i in range(5)] + [(20, "это что как " * 5, "ru", "", 0)]
    model = language_id.learn(spark.createDataFrame(train, DOCS), F.lit(True))
    text = "the and with this that from der die und nicht auch eine это что как"
    spans = language_id.label_spans(spark.createDataFrame([(1, text, None, None, 0)], DOCS), model, 3.0).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert text[spans[1]["first"] : spans[1]["end"]].startswith("der")


def test_crf(spark, docs, wide):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (2, 0, None), (None, 1, 1), (7, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.learn(docs, labels, F.lit(True))
    out = rows(quality_crf.score(wide, model), "doc_id", "score")
    assert len(out) == len(ROWS) and all(0 <= s <= 1 for _, s in out)
    assert quality_crf.score(docs.limit(0), model).count() == 0
    assert {s for _, s in rows(quality_crf.score(docs, quality_crf.learn(docs, labels.limit(0), F.lit(True))), "doc_id", "score")} == {0.5}


def test_rules(docs, wide):
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert out[2]["n_words"] == 0 and out[2]["base_failed"] and not out[2]["kept"]
    assert out[5]["n_words"] == 120_000
    assert quality_rules.quality_rules(wide).count() == len(ROWS)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_token_files(spark, docs, wide):
    for x, n in ((wide, len(ROWS)), (docs.limit(0), 0)):
        path = new_path(spark, "tokens")
        token_files.write_tokens(x, path, vocabulary("word_bpe_49k.json"), 2)
        got = token_files.checksums(token_files.read_tokens(spark, path)).collect()
        assert len(got) == n
        ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    rows_ = spark.read.orc(path)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in rows_.where("doc_id = 5")._jdf.queryExecution().toString()


def test_decontaminate(spark, docs, wide):
    bench = spark.createDataFrame([(1, "lazy dog and then"), (2, None), (3, ""), (None, "quick brown"), (4, "rests for a while in the shade"), (4, "rests for a while in the shade")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.find_items(wide, bench).collect()}
    assert out[1]["items"] == ["1", "4"] and out[1]["n_hit"] == 11 and out[2]["n_words"] == 0
    many = {r["doc_id"]: r for r in decontaminate.find_items(docs, bench, block_words=1).collect()}
    assert all(many[k]["items"] == out[k]["items"] and many[k]["n_hit"] == out[k]["n_hit"] and many[k]["hits"] == out[k]["hits"] for k in out)
    assert decontaminate.find_items(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0
    left = decontaminate.remove_spans(docs, bench)
    assert left.columns == docs.columns and 1 not in {r["doc_id"] for r in left.collect()}
    assert passed(decontaminate.remove_spans(wide, bench))


def test_line_dedup(spark, docs, wide):
    out = rows(line_dedup.dedup_lines(wide).where("doc_id is not null"), "doc_id", "n_removed")
    assert [n for d, n in out if d == 6] == [4, 4] and [n for d, n in out if d == 1] == [0]
    assert line_dedup.dedup_lines(docs).count() == len(ROWS)
    assert line_dedup.dedup_lines(wide).columns == [*wide.columns, "n_removed"] and passed(line_dedup.dedup_lines(wide))
    assert line_dedup.dedup_lines(docs, drop_emptied=True).where("doc_id = 6").count() == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    merged = spark.createDataFrame([(1, "a\nb\nc\nd\n\nx"), (2, "q\na\nb\n\nc\nd\nz")], "doc_id long, text string")
    assert rows(line_dedup.dedup_lines(merged), "doc_id", "text") == [(1, "a\nb\nc\nd\n\nx"), (2, "q\n\nz")]


def test_bpe(docs, wide):
    path = vocabulary("byte_bpe_50k.json")
    x = bpe.encode_and_decode(wide, path)
    assert x.count() == len(ROWS)
    assert x.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.round_trip(docs.limit(0), path).count() == 0
    assert bpe.decode(bpe.encode(docs, path), path).where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p>First &amp; best<br>words.<p>Second   one</p></article><div id='comments'><p>me too</p></div><footer>end</footer></body></html>"
    plain = "<body><div class='menu'><a>x</a> <a>y</a></div><div><p>A long paragraph of text that says something.</p><p>Another one that goes on for a while, too.</p></div><div class='footer'>f</div></body>"
    data = [(1, "u", page, 1), (2, "u", None, 1), (3, None, "", 1), (4, "u", "<script>var t='</p>';", 1), (None, "u", plain, 1), (1, "u", page, 1), (6, "u", "<p>" * 50_000 + "deep", 1), (7, "u", "just text", 1)]
    out = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string, n_chars int"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[1] == ("Head First & best words. Second one", 35) and got[2] == got[3] == got[4] == ("", 0)
    assert got[None][0] == "A long paragraph of text that says something. Another one that goes on for a while, too."
    assert got[6][0] == "deep" and got[7][0] == "just text"
    assert out.count() == len(data) and html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string, n int").limit(0)).count() == 0


def test_pipeline_stages(spark, docs, wide, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "never seen in any of these texts")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for x in (wide, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, x, sf)
            out.collect()
            if name != "bpe":
                assert out.columns == x.columns, name
                assert x is not wide or passed(out), name
