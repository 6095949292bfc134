"""Language of texts, word by word.

The script of a word leaves the languages that were seen in it. Those get a score from the word's letter
sequences, and Viterbi's algorithm with a price for each switch labels spans of one language. A document's
language is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, kept

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (2, 3)
CACHE = 300_000  # words whose scores a worker keeps
#: First code points of blocks and the script that begins there.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
FIRSTS = np.array([x for x, _ in SCRIPTS])


def script_of(word: str) -> str:
    return SCRIPTS[max(0, int(np.searchsorted(FIRSTS, ord(word[0]), "right")) - 1)][1]


def grams(word: str) -> list[str]:
    w = f"^{word.lower()}$"
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


def learn(docs: DataFrame, use: F.Column, per_language: int = 1500, seed: int = 11) -> dict:
    """A model from the text and lang of about per_language of the rows of each language that `use` admits.

    That bound on the sample is the only one: rows are taken by a hash of doc_id under a rate that each
    language's count gives. Without a labelled row the model knows no language.
    """
    labelled = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "grams": {}, "scripts": {}}
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    sample = labelled.where(chance < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def count(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in Counter(WORD.findall(text)).items():
                    total[lang, "script " + script_of(word)] += n * len(word)
                    for g in grams(word):
                        total[lang, g] += n
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "gram", "n"])

    rows = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    table: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for lang, gram, n in rows:
        into = scripts if gram.startswith("script ") else table
        into.setdefault(gram.removeprefix("script "), np.zeros(len(langs)))[langs.index(lang)] += n
    total = np.maximum(1, sum(scripts.values(), np.zeros(len(langs))))
    logs = {}
    for order in ORDERS:
        own = [g for g in table if len(g) == order]
        if own:
            c = np.array([table[g] for g in own]) + 0.5
            logs |= dict(zip(own, np.log(c / (c.sum(0) + 0.5)).astype(np.float32), strict=True))
            logs["?" * order + "?"] = np.log(0.5 / (c.sum(0) + 0.5)).astype(np.float32)
    return {"langs": langs, "grams": logs, "scripts": {k: v / total >= 0.001 for k, v in scripts.items()}}


class Labeller:
    def __init__(self, model: dict, price: float):
        self.model, self.price, self.n = model, price, len(model["langs"])
        self.gram = {g: i for i, g in enumerate(model["grams"])}
        self.logs = np.array(list(model["grams"].values()), np.float32).reshape(-1, max(1, self.n))
        self.row: dict[str, int] = {}
        self.script: dict[str, str] = {}
        self.scores = np.zeros((CACHE, max(1, self.n)), np.float32)
        self.size = np.zeros(CACHE, np.int32)

    def score(self, words: list[str]) -> np.ndarray:
        """Log odds of each word against its best language; far below for languages not seen in its script."""
        get, found, starts = self.gram.get, array("i"), []
        rare = {n: self.gram.get("?" * n + "?", 0) for n in ORDERS}
        scripts = [self.script.get(w[0]) or self.script.setdefault(w[0], script_of(w)) for w in words]
        for word in words:
            starts.append(len(found))
            w = f"^{word.lower()}$"
            for n in ORDERS:
                found.extend([get(w[i : i + n], rare[n]) for i in range(len(w) - n + 1)])
        s = np.add.reduceat(self.logs[np.frombuffer(found, np.int32)], starts, 0)
        for script in set(scripts):
            seen = self.model["scripts"].get(script)
            if seen is not None and seen.any() and not seen.all():
                own = np.array([x == script for x in scripts])
                s[own] = np.where(seen, s[own], s[own].max(1, keepdims=True) - 50)
        return (s - s.max(1, keepdims=True)) / len(ORDERS)

    def learn(self, words: set[str]) -> None:
        """Scores what it has no scores of; makes room by forgetting all."""
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > len(self.size):
            self.row.clear()
            new = list(words)
        if not new:
            return
        if len(new) > len(self.size):
            self.scores, self.size = np.zeros((len(new), self.n), np.float32), np.zeros(len(new), np.int32)
        at = len(self.row)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))
        self.scores[at : at + len(new)] = self.score(new)
        self.size[at : at + len(new)] = list(map(len, new))

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def label(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word, switches priced."""
        best = int(s.sum(0).argmax())
        # No stretch gains more than a switch's price over the best language, nor do a first and a last stretch together,
        # which cost one switch if the best language has no word: then one span is the best labelling.
        c = np.concatenate([np.zeros((1, self.n)), np.cumsum(s - s[:, best : best + 1], 0, dtype=np.float64)])
        if (c - np.minimum.accumulate(c)).max() <= self.price and c.max() + (c[-1] - c).max() <= self.price:
            return np.full(len(s), best)
        v, back = s[0].tolist(), []
        for row in s[1:].tolist():
            top = max(v)
            first, least = v.index(top), top - self.price
            back.append([k if x >= least else first for k, x in enumerate(v)])
            v = [(x if x >= least else least) + e for x, e in zip(v, row, strict=True)]
        out = np.empty(len(s), np.int64)
        out[-1] = at = v.index(max(v))
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = at = back[t - 1][at]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first, end, language) of the spans, in characters of the text."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.n:
            return []
        words = [m[0].lower() for m in found]
        self.learn(set(words))
        labels = self.label(self.scores[self.places(words)])
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        return [(found[i].start(), found[j - 1].end(), self.model["langs"][labels[i]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def documents(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, its share of the letters, number of spans."""
        rows = [WORD.findall(t.lower()) if t and self.n else [] for t in texts]
        self.learn(set().union(*rows))
        out = []
        for words in rows:
            if not words:
                out.append(("und", 0.0, 0))
                continue
            at = self.places(words)
            labels = self.label(self.scores[at])
            letters = np.bincount(labels, self.size[at], self.n)
            top = int(letters.argmax())
            out.append((self.model["langs"][top], float(letters[top] / letters.sum()), 1 + int((labels[1:] != labels[:-1]).sum())))
        return out


def identify(docs: DataFrame, model: dict, price: float = 8.0, prefix: str = "", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred, score (the language's share of the letters) and n_spans, each name after prefix.

    `und` with score 0 for a null text, a text without letters or a model without languages. Equal shares go to
    the language first in order. Input columns that have a result's name are replaced.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by learn()'s sample

    def run():
        labeller = kept(("language", name), lambda: Labeller(sent.value, price))
        return lambda texts: list(zip(*labeller.documents(texts), strict=True)) or [[]] * 3

    return annotate(docs, run, f"{prefix}lang_pred string, {prefix}score double, {prefix}n_spans long", drop=drop)


def label_spans(docs: DataFrame, model: dict, price: float = 8.0) -> DataFrame:
    """docs with spans, an array of (first, end, lang) in characters of the text.

    A null text, one without letters or a model without languages has none. Of labellings of equal value the one that
    keeps a word's language longest, looking back, is taken; repeated rows get the same. A column named spans is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run():
        labeller = Labeller(sent.value, price)
        return lambda texts: [[[{"first": a, "end": b, "lang": c} for a, b, c in labeller.spans(t)] for t in texts]]

    return annotate(docs, run, "spans array<struct<first: long, end: long, lang: string>>")
