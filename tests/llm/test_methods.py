"""Results of the methods against brute force, the library, or held-out labels."""

import random
import zlib

import pytest

pytest.importorskip("pulseloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pulseloom.llm import near_dedup, queries
from pulseloom.llm.bpe import Bpe
from pulseloom.llm.decontaminate import Automaton
from pulseloom.llm.language_id import Labeller
from pulseloom.llm.near_dedup import near_duplicates
from pulseloom.llm.quality_crf import marginals
from pulseloom.llm.token_files import WordCache

SF = "/root/testdata/sf0.01"


def near_truth(texts, k, percent):
    sets = {}
    for d, t in texts:
        w = t.split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    comp = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = comp[a], comp[b]
                comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    return comp


def test_near_duplicates_with_a_dense_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for d in range(250):
        w = base[:] if d < 200 else [f"v{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(rng.randrange(0, 6) if d < 200 else 0):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((d, " ".join(w)))
    texts += [(900 + i, t) for i, (_, t) in enumerate(texts[:40])]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == near_truth(texts, 3, 85)


def template_pairs(n, shared=170, pair=10, own=15):
    """n pairs of texts over one template, with words of the pair and of the text: similar by 0.857 in a pair and by
    0.773 otherwise, at one-word shingles."""
    base, texts = [f"t{i}" for i in range(shared)], []
    for p in range(n):
        both = base + [f"p{p}x{i}" for i in range(pair)]
        texts += [(2 * p + s, " ".join(both + [f"o{2 * p + s}x{i}" for i in range(own)])) for s in (0, 1)]
    return texts


@pytest.mark.parametrize("threshold, own", [(0.85, 15), (0.8, 22)])
def test_near_duplicates_in_large_nodes(spark, monkeypatch, threshold, own):
    """Nodes that stay large to the deepest level. Found is what RECALL promises, less three standard deviations."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "PART", 8)
    n, p = 300, 0.99
    texts = template_pairs(n, own=own)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 1, threshold).collect()
    assert all(r["component_id"] in (r["doc_id"], r["doc_id"] - r["doc_id"] % 2) for r in got)
    found = sum(not r["kept"] for r in got)
    assert found >= n * p - 3 * (n * p * (1 - p)) ** 0.5, found


def test_parts_of_a_node_hold_all_pairs_across_components(spark):
    """Dealt out in blocks, each two classes of different components meet in some part, and rows stay few."""
    rows = [(0, 7, bytes([i]), "t" if i < 150 else str(i), 1 if i < 150 else i) for i in range(180)]
    x = spark.createDataFrame(rows, "tree int, node long, cid binary, comp string, h long").selectExpr("*", "180L AS n", "150L AS m", "1L AS top")
    parts = {}
    out = near_dedup.dealt(x, 16, 1, True).collect()
    for r in out:
        parts.setdefault(r["part"], []).append((r["cid"][0], r["comp"]))
    met = {(a, b) for p in parts.values() for a, c in p for b, d in p if a < b and c != d}
    assert met == {(a, b) for b in range(150, 180) for a in range(b)}
    assert len(out) < 5 * len(rows)


def test_trees_grow_with_depth():
    for threshold in (0.8, 0.85):
        counts = [near_dedup.trees_for(level, threshold, 10) for level in range(3, 12, 2)]
        assert counts == sorted(counts) and counts[0] == 10 < counts[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aAbB '.\n\t1éİΣß<|>\x1c é", max_size=40))
def test_tokenizers_agree(text):
    text = text.encode("utf-8", "ignore").decode()
    from tokenizers import Tokenizer

    for kind, name in ((WordCache, "word_bpe_49k.json"), (Bpe, "byte_bpe_50k.json")):
        path = queries.vocabulary(name)
        own = CACHE.setdefault(name, kind(path))
        library = CACHE.setdefault(name + " library", Tokenizer.from_file(path))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == want
    assert own.decode(own.encode([text])[0]) == library.decode(want, skip_special_tokens=False)


CACHE: dict = {}


def test_special_tokens():
    text = "a <|endoftext|>b<|startoftext|> <|endoftext|>"
    test_tokenizers_agree.hypothesis.inner_test(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(2, 5))
def test_automaton(items, words, window):
    enc = lambda x: [w.encode() for w in x]
    own = Automaton([(str(i), enc(x)) for i, x in enumerate(items)], window)
    hit, found = np.zeros(len(words), bool), set()
    if words:
        own.match(enc(words), hit, found)
    want, names = set(), set()
    for i, x in enumerate(items):
        for k in range(max(1, len(x) - window + 1) if x else 0):
            w = x[k : k + window]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    want |= set(range(p, p + len(w)))
                    names.add(str(i))
    assert set(np.flatnonzero(hit).tolist()) == want and found == names


def test_viterbi_takes_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.normal(size=(7, 3)).astype(np.float32) * 3
        own = Labeller({"langs": ["a", "b", "c"], "grams": {}, "scripts": {}}, 2.0)
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(value(p) for p in np.ndindex(*[3] * 7))
        assert value(own.label(s).tolist()) == pytest.approx(best, abs=1e-4)


def test_viterbi_without_the_best_language():
    """One switch between two languages pays for both gains over the language that is best overall."""
    own = Labeller({"langs": ["a", "b", "c"], "grams": {}, "scripts": {}}, 8.0)
    assert own.label(np.array([[0, -6, -100], [-100, -6, 0]], np.float32)).tolist() == [0, 2]
    rng = np.random.default_rng(2)
    for _ in range(100):
        s = -rng.integers(0, 9, (5, 3)).astype(np.float32)
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 8.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(own.label(s).tolist()) == max(value(p) for p in np.ndindex(*[3] * 5))


def test_marginals():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=(2, 4)), rng.normal(size=(2, 2))
    p, pairs, z = marginals(e, np.array([4, 3]), trans)
    for row, n in ((0, 4), (1, 3)):
        weights = {y: sum(e[row, i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)) for y in np.ndindex(*[2] * n)}
        total = sum(map(np.exp, weights.values()))
        assert z[row] == pytest.approx(np.log(total))
        for i in range(n):
            assert p[row, i] == pytest.approx(sum(np.exp(w) for y, w in weights.items() if y[i]) / total)
    assert pairs.sum() == pytest.approx(5)


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lang = [r for r in queries.op3_language_id(spark, SF).collect() if r["held_out"]]
    assert len(lang) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in docs)
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in lang]) > 0.95
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality = [r for r in queries.op4_quality_crf(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([labels[r["doc_id"]] == r["predicted"] for r in quality]) > 0.9


def test_queries_with_sql_agree(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = c.sql(sql).project(", ".join(cols)).fetchall()
        assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want)), name
