"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Emissions use features of the line and of its two neighbours, transitions favour
runs. Training takes each labelled document's label for all its lines. The forward-backward marginals of the
lines, weighted by their lengths, make a document's goodness, and a logistic curve fitted on the training
documents turns it into the probability of label 1.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, staged

WIDTH = 17
SYMBOL = re.compile(r"[#*$%&|<>^~_=+@\\{}\[\]]")
UPPER = re.compile(r"[^\W\d_a-z]")


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line."""
    out = np.zeros((len(lines), WIDTH), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, k = len(words), max(1, len(words))
        size = max(1, len(line))
        distinct = len(set(words))
        letters = sum(map(str.isalpha, line)) if not line.isascii() else size - len(line.translate(NO_LETTERS))
        upper = len(UPPER.findall(line)) if line.isascii() else sum(map(str.isupper, line))
        run = best = 1
        if distinct < n:
            for a, b in zip(words, words[1:], strict=False):
                run = run + 1 if a == b else 1
                best = max(best, run)
        out[i] = (
            1, np.log1p(size), np.log1p(n), len(SYMBOL.findall(line)) / size, line.count("|") / k, line.count("!") / k, upper / max(1, letters), letters / size,
            sum(map(str.isdigit, line)) / size, size / k / 10, distinct / k, best / k if n > 3 else 0, float(n < 4), float(n > 0 and line.rstrip()[-1:] in ".!?"),
            float(line in seen), float(line[:1].isupper()), sum(len(w) < 4 for w in words) / k,
        )
        seen.add(line)
    return out


NO_LETTERS = {ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def with_neighbours(x: np.ndarray) -> np.ndarray:
    none = np.zeros((1, WIDTH), np.float32)
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines that aren't blank; one empty line if there is none."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    return with_neighbours(line_features(lines)), np.array([max(1, len(x)) for x in lines], np.float64)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, longest) of 1-d rows, sorted by falling length, and the sizes."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max()))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


def marginals(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions and log Z; e: log odds of good, documents by falling size."""
    d, t = e.shape
    emit = np.stack([np.zeros_like(e), e], 2)
    alpha, beta = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    alive = [int((sizes > i).sum()) for i in range(t)]
    add = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        n = alive[i]
        alpha[:n, i] = emit[:n, i] + add(np.swapaxes(alpha[:n, i - 1, :, None] + trans, 1, 2))
    for i in range(t - 2, -1, -1):
        n = alive[i + 1]
        beta[:n, i] = add(trans + (emit[:n, i + 1] + beta[:n, i + 1])[:, None, :])
    z = add(alpha[np.arange(d), sizes - 1])
    p = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - z[:, None]))
    p[np.arange(t) >= sizes[:, None]] = 0
    pairs = np.zeros((2, 2))
    for i in range(1, t):
        n = alive[i]
        x = alpha[:n, i - 1, :, None] + trans + (emit[:n, i] + beta[:n, i])[:, None, :] - z[:n, None, None]
        pairs += np.exp(np.minimum(0, x)).sum(0)
    return p, pairs, z


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def goodness(feats: list[np.ndarray], lengths: list[np.ndarray], model: dict) -> np.ndarray:
    """Mean of the lines' marginals, weighted by length."""
    order = np.argsort([-len(f) for f in feats], kind="stable")
    out = np.zeros(len(feats))
    for part in np.array_split(order, max(1, len(order) // 64)):
        e, sizes = padded([(feats[i] - model["mean"]) / model["std"] @ model["w"] for i in part])
        p, _, _ = marginals(e, sizes, model["trans"])
        for k, i in enumerate(part):
            out[i] = np.average(p[k, : sizes[k]], weights=lengths[i])
    return out


def fit(feats: list[np.ndarray], lengths: list[np.ndarray], y: np.ndarray, steps: int = 120, l2: float = 1e-3) -> dict:
    """Gradient ascent (Adam) on the mean log-likelihood of a line; then the logistic curve."""
    flat = np.vstack(feats)
    mean, std = flat.mean(0), flat.std(0) + 1e-3
    mean[[i for i in range(len(mean)) if flat[:, i].std() == 0]] = 0  # a constant stays as bias
    order = np.argsort([-len(f) for f in feats], kind="stable")
    groups = [part for part in np.array_split(order, max(1, len(order) // 256)) if len(part)]
    x = [np.vstack([(feats[i] - mean) / std for i in part]) for part in groups]
    sizes = [np.array([len(feats[i]) for i in part]) for part in groups]
    masks = [np.arange(s.max()) < s[:, None] for s in sizes]
    total = len(flat)
    theta = np.zeros(flat.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, trans, grad = theta[:-4], theta[-4:].reshape(2, 2), np.zeros_like(theta)
        for part, xs, s, mask in zip(groups, x, sizes, masks, strict=True):
            e = np.zeros(mask.shape)
            e[mask] = xs @ w
            p, pairs, _ = marginals(e, s, trans)
            label = y[part]
            grad[:-4] += ((label[:, None] - p)[mask]) @ xs
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = ((s - 1) * (label == 0)).sum(), ((s - 1) * (label == 1)).sum()
            grad[-4:] += (seen - pairs).ravel()
        grad = grad / total - l2 * theta
        grad[-4:] -= 0.05 * theta[-4:]  # labels of documents say little of switches
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"mean": mean, "std": std, "w": theta[:-4], "trans": theta[-4:].reshape(2, 2), "a": 1.0, "b": 0.0}
    g = logit(goodness(feats, lengths, model))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a weak pull to a = 1
        p = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
        r, h = y - p, p * (1 - p) + 1e-9
        ga, gb = (r * g).sum() - (a - 1), r.sum() - 0.01 * b
        haa, hab, hbb = (h * g * g).sum() + 1, (h * g).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return model | {"a": float(np.clip(a, 0.05, 5)), "b": float(np.clip(b, -20, 20))}


def learn(docs: DataFrame, labels: DataFrame, use: F.Column, most: int = 6000, most_lines: int = 500_000, seed: int = 5) -> dict:
    """A model from about `most` of the labelled documents that `use` (of doc_id) admits, taken by a hash of doc_id.

    These bounds are the only ones: `most` documents and, as their lines' features (204 bytes each) go to the driver,
    `most_lines` lines; documents with more than a tenth of these are not learned from. Labels that are null are left
    out; of a doc_id's several labels the least counts. Without labels every score is 0.5.
    """
    known = labels.where(use & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    drawn = known.where(chance < min(1.0, most / max(1, n))).withColumn("at", chance)
    sample = staged(docs.select("doc_id", "text").join(drawn, "doc_id").withColumn("lines", F.size(F.split("text", "\n", -1))), "sample").where(F.col("lines") <= most_lines // 10)
    so_far = Window.partitionBy(F.lit(0)).orderBy("at", "doc_id", "lines").rowsBetween(Window.unboundedPreceding, 0)  # about `most` rows of numbers
    within = sample.select("doc_id", "at", "lines").withColumn("sum", F.sum("lines").over(so_far)).where(F.col("sum") <= most_lines).select("doc_id").distinct()
    sample = sample.join(within, "doc_id").select("doc_id", "quality", "text")

    def run():
        def work(texts):
            made = [features_of(t) for t in texts]
            return [[f.astype(np.float32).tobytes() for f, _ in made], [s.tobytes() for _, s in made]]

        return work

    rows = annotate(sample, run, "f binary, s binary", drop=("text",)).select("doc_id", "quality", "f", "s").collect()
    if not rows:
        return {}
    rows.sort(key=lambda r: (r["doc_id"], r["f"]))
    feats = [np.frombuffer(r["f"], np.float32).reshape(-1, 3 * WIDTH) for r in rows]
    return fit(feats, [np.frombuffer(r["s"], np.float64) for r in rows], np.array([float(r["quality"] == 1) for r in rows]))


def score(docs: DataFrame, model: dict, field: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the probability of label 1; a null, empty or blank text is scored as one empty line."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run():
        m = sent.value

        def work(texts):
            if not m:
                return [[0.5] * len(texts)]
            if not texts:
                return [[]]
            feats, lengths = zip(*map(features_of, texts), strict=True)
            g = logit(goodness(feats, lengths, m))
            return [(1 / (1 + np.exp(-np.clip(m["a"] * g + m["b"], -30, 30)))).tolist()]

        return work

    return annotate(docs, run, f"`{field}` double", drop=drop)
