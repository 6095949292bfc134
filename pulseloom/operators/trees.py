"""Boosted-tree forecasters: many models at once, each fitted in a task of its own.

A study fits a model per training window, label and set of features. They don't depend on each other, so the rows are
dealt to the fits that use them and every fit runs in one task, on all its rows or a sample of a fixed size, with
leaf-wise trees over histograms of quantile bins. Scoring is one pass over all rows with all models.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64  # of a feature's present values
MOST = 500_000  # rows that one fit takes at most, drawn by a hash; at 60 features 120 MB
MODEL = "feature array<int>, cut array<double>, missing array<boolean>, low array<int>, high array<int>, value array<double>, roots array<int>"


@dataclass(frozen=True)
class Fit:
    """A model to fit: its name, features, label (0 or 1), the rows it learns from, rounds and settings over parameters().

    rates: names of states and, for each group (a value of the first column that names a row), base rates and a matrix
    of weights; the intensities that they give are features too.
    """

    name: str
    features: list[str]
    label: str
    rows: Column | None = None
    rounds: int = 160
    settings: dict = field(default_factory=dict)
    rates: tuple[list[str], dict] | None = None

    def columns(self) -> list[str]:
        return [*self.features, *(self.rates[0] if self.rates else ())]


def design(f: Fit, places: dict[str, int], x: np.ndarray, groups: list) -> np.ndarray:
    """The features of a fit from a matrix of columns at `places`; rates of a group without weights are missing."""
    out = [x[:, [places[c] for c in f.features]]]
    if f.rates:
        names, weights = f.rates
        z, own = x[:, [places[c] for c in names]], np.full((len(x), max((len(mu) for mu, _ in weights.values()), default=0)), np.nan)
        groups = np.asarray(groups, object)
        for g, (mu, alpha) in weights.items():
            on = groups == g
            own[on] = np.maximum(1e-12, np.asarray(mu) + z[on] @ np.asarray(alpha).T)
        out.append(own)
    return np.hstack(out)


def parameters(n: int) -> dict:
    """More rows allow larger trees. The borders and settings of the studies."""
    if n < 20_000:
        return {"leaves": 7, "least": 200, "fraction": 0.65, "l2": 10.0}
    if n < 100_000:
        return {"leaves": 15, "least": 300, "fraction": 0.75, "l2": 5.0}
    return {"leaves": 31, "least": 500, "fraction": 0.85, "l2": 2.0}


class Boosting:
    """Trees of a matrix with NaN for missing values, for a label of 0 and 1; positives weigh as much as negatives in sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int, leaves: int, least: int, fraction: float, l2: float, rate: float = 0.05, seed: int = 3):
        self.least, self.l2, self.leaves = least, l2, leaves
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(v := c[~np.isnan(c)]) else np.empty(0) for c in x.T]
        self.bins = np.empty(x.shape[::-1], np.uint8)  # 0 is missing
        for i, (c, cut) in enumerate(zip(x.T, self.cuts, strict=True)):
            self.bins[i] = np.where(np.isnan(c), 0, 1 + np.searchsorted(cut, c, "left"))
        weight = np.where(y == 1, (len(y) - y.sum()) / max(1, y.sum()), 1.0)
        self.nodes: list[tuple] = []  # feature (-1: a leaf), cut, missing goes low, low, high, value
        self.roots: list[int] = []
        margin, rng = np.zeros(len(y)), np.random.default_rng(seed)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            self.g, self.h = weight * (p - y), weight * p * (1 - p)
            self.used = np.sort(rng.choice(x.shape[1], max(1, round(fraction * x.shape[1])), False))
            for rows, value in self.grow(rate):
                margin[rows] += value

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        """Sums of gradients, of curvatures and numbers of rows, by feature and bin."""
        g, h, n = self.g[rows], self.h[rows], BINS + 1
        out = np.empty((3, len(self.used), n))
        for i, f in enumerate(self.used):
            b = self.bins[f][rows]
            out[0, i], out[1, i], out[2, i] = np.bincount(b, g, n), np.bincount(b, h, n), np.bincount(b, minlength=n)
        return out

    def best(self, hist: np.ndarray) -> tuple[float, int, int, bool] | None:
        """Gain, feature (its place in used), last bin that goes low and whether missing values do, of the best cut."""
        total, gone = hist[:, 0].sum(1), hist[:, :, :1]
        low = np.cumsum(hist[:, :, 1:], 2)  # the last holds all present values
        low = np.stack([low, low + gone])  # missing values high, low
        high = total[None, :, None, None] - low
        score = low[:, 0] ** 2 / (low[:, 1] + self.l2) + high[:, 0] ** 2 / (high[:, 1] + self.l2)
        score[(np.minimum(low[:, 2], high[:, 2]) < self.least) | (np.minimum(low[:, 1], high[:, 1]) < 1e-3)] = -np.inf
        at = np.unravel_index(score.argmax(), score.shape)
        gain = score[at] - total[0] ** 2 / (total[1] + self.l2)
        return (float(gain), int(at[1]), int(at[2]) + 1, bool(at[0])) if gain > 1e-12 else None

    def grow(self, rate: float) -> list[tuple[np.ndarray, float]]:
        """One tree: the leaf with the largest gain is cut until there are enough; rows and values of the leaves."""
        self.roots.append(len(self.nodes))
        held: dict[int, tuple] = {}
        heap: list[tuple[float, int]] = []

        def add(rows, hist):
            at = len(self.nodes)
            self.nodes.append((-1, 0.0, False, -1, -1, -rate * self.g[rows].sum() / (self.h[rows].sum() + self.l2)))
            held[at] = rows, hist, (cut := self.best(hist))
            if cut:
                heappush(heap, (-cut[0], at))
            return at

        rows = np.arange(self.bins.shape[1])
        add(rows, self.histogram(rows))
        while heap and len(held) < self.leaves:
            _, at = heappop(heap)
            rows, hist, (_, i, last, missing) = held.pop(at)
            f = int(self.used[i])
            b = self.bins[f][rows]
            down = np.where(b == 0, missing, b <= last)
            low, high = rows[down], rows[~down]
            few = self.histogram(low if len(low) < len(high) else high)
            a, c = (few, hist - few) if len(low) < len(high) else (hist - few, few)
            cut = float(self.cuts[f][last - 1]) if last <= len(self.cuts[f]) else np.inf  # past the last cut only missing values go high
            self.nodes[at] = (f, cut, missing, add(low, a), add(high, c), 0.0)
        return [(rows, self.nodes[at][5]) for at, (rows, _, _) in held.items()]

    def model(self) -> dict:
        kinds = (int, float, bool, int, int, float)
        columns = [list(map(k, c)) for k, c in zip(kinds, zip(*self.nodes, strict=True), strict=True)]
        return dict(zip(("feature", "cut", "missing", "low", "high", "value"), columns, strict=True)) | {"roots": self.roots}


class Scorer:
    """Probabilities of rows by a model."""

    def __init__(self, model: dict):
        self.feature, self.cut, self.missing, self.low, self.high, self.value, self.roots = (np.asarray(model[k]) for k in ("feature", "cut", "missing", "low", "high", "value", "roots"))
        self.leaf = self.feature < 0
        own = np.arange(len(self.feature))
        self.low, self.high = np.where(self.leaf, own, self.low), np.where(self.leaf, own, self.high)

    def __call__(self, x: np.ndarray, slab: int = 1000) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), slab):
            part = x[i : i + slab]
            at, row = np.tile(self.roots, (len(part), 1)), np.arange(len(part))[:, None]
            while not self.leaf[at].all():
                v = part[row, np.maximum(0, self.feature[at])]
                at = np.where(np.where(np.isnan(v), self.missing[at], v <= self.cut[at]), self.low[at], self.high[at])
            out[i : i + slab] = 1 / (1 + np.exp(-self.value[at].sum(1)))
        return out


def vector(features: list[str]) -> Column:
    return F.array(*(F.col(f"`{f}`").cast("double") for f in features))


def matrix_of(lists, width: int) -> np.ndarray:
    """Rows of an Arrow column of equally long lists, nulls as NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def fit_all(df: DataFrame, fits: list[Fit], order: list[str], most: int | None = MOST) -> dict[str, tuple[Fit, dict]]:
    """Each fit's model, by name; none for fits whose rows don't show both labels.

    order: columns that name a row. most: rows of a fit, None for all, which its task then holds. df is read three times, so it should be a written table. What the driver gets are
    the models: rounds times twice the leaves times 25 bytes each, whatever the rows.
    """
    import pyarrow as pa

    if not fits:
        return {}
    use = {f.name: F.lit(True) if f.rows is None else F.coalesce(f.rows, F.lit(False)) for f in fits}
    counts = df.agg(*(F.struct(F.count_if(use[f.name]), F.count_if(use[f.name] & (F.col(f.label) == 1))) for f in fits)).first()
    sized = [(f, n, ones) for f, (n, ones) in zip(fits, counts, strict=True) if 0 < ones < n]
    if not sized:
        return {}
    names = sorted({c for f in fits for c in f.columns()})
    places = {c: i for i, c in enumerate(names)}
    chance = F.pmod(F.xxhash64(*order, F.lit(29)), F.lit(1_000_003)) / 1_000_003
    share = lambda n: F.lit(True) if most is None or n <= most else chance < most / n
    dealt = [F.when(use[f.name] & share(n), F.struct(F.lit(i).alias("fit"), F.col(f.label).cast("double").alias("y"))) for i, (f, n, _) in enumerate(sized)]
    own = {i: (replace(f, rows=None), parameters(n) | f.settings) for i, (f, n, _) in enumerate(sized)}  # columns can't be sent
    keys = [f"k{i}" for i in range(len(order))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), vector(names).alias("x"), F.explode(F.filter(F.array(*dealt), lambda s: s.isNotNull())).alias("f"))
    rows = rows.select("f.fit", "f.y", "x", *keys).repartition(min(2000, 4 * len(sized)), "fit")

    def run(key, table):
        table = table.sort_by([(k, "ascending") for k in keys])
        i = key[0].as_py()
        f, settings = own[i]
        x = design(f, places, matrix_of(table.column("x").combine_chunks(), len(names)), table.column("k0").to_pylist())
        model = Boosting(x, table.column("y").to_numpy(), f.rounds, **settings).model()
        kinds = {"feature": pa.list_(pa.int32()), "cut": pa.list_(pa.float64()), "missing": pa.list_(pa.bool_()), "low": pa.list_(pa.int32()), "high": pa.list_(pa.int32()), "value": pa.list_(pa.float64()), "roots": pa.list_(pa.int32())}
        return pa.table({"fit": pa.array([i], pa.int32())} | {k: pa.array([model[k]], t) for k, t in kinds.items()})

    made = rows.groupBy("fit").applyInArrow(run, "fit int, " + MODEL).collect()
    return {sized[r["fit"]][0].name: (sized[r["fit"]][0], r.asDict()) for r in sorted(made, key=lambda r: r["fit"])}


def score_all(df: DataFrame, models: dict[str, tuple[Fit, dict]], keep: list[str], where: dict[str, Column] | None = None) -> DataFrame:
    """The columns `keep` of df and a column of probabilities named like each model; null where `where` doesn't hold for it.

    The first of `keep` is the group of a fit's rates. The models are broadcast; their size is that of fit_all().
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    spark, where = df.sparkSession, where or {}
    names = sorted({c for f, _ in models.values() for c in f.columns()})
    places = {c: i for i, c in enumerate(names)}
    sent = spark.sparkContext.broadcast([(replace(f, rows=None), m) for f, m in models.values()])
    token = uuid.uuid4().hex
    asked = F.array(*(F.coalesce(where.get(n, F.lit(True)), F.lit(False)) for n in models)) if models else F.array().cast("array<boolean>")
    rows = df.select(*keep, vector(names).alias(f"x{token}"), asked.alias(f"w{token}"))
    schema = StructType([rows.schema[c] for c in keep])
    for n in models:
        schema = schema.add(n, "double")

    def run(batches):
        scorers = [(f, Scorer(m)) for f, m in sent.value]
        for b in batches:
            x = matrix_of(b.column(len(keep)), len(names)) if names else np.empty((b.num_rows, 0))
            w = b.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, len(scorers)) if scorers else None
            groups, out = np.asarray(b.column(0).to_pylist(), object), []
            for k, (f, scorer) in enumerate(scorers):
                p = np.full(b.num_rows, np.nan)
                if (on := w[:, k]).any():
                    p[on] = scorer(design(f, places, x[on], groups[on]))
                out.append(pa.array(p, pa.float64(), mask=~on))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out], schema.names)

    return rows.mapInArrow(run, schema)


def candidates(count: int, seed: int = 3) -> list[dict]:
    """The default settings and count - 1 different random ones. The choices."""
    import random

    rng, out = random.Random(seed), [{}]
    while len(out) < count:
        new = {"leaves": rng.choice([7, 15, 31, 63, 127]), "least": rng.choice([30, 50, 100, 200, 300, 500, 800]), "fraction": rng.choice([0.6, 0.7, 0.8, 0.9, 1.0]), "l2": rng.choice([0.5, 1.0, 2.0, 5.0, 10.0, 20.0])}
        if new not in out:
            out.append(new)
    return out


def tuned(df: DataFrame, fits: list[Fit], time: str, order: list[str], count: int = 16, share: float = 0.15) -> dict[str, tuple[Fit, dict, float, float]]:
    """For each fit, the best of `count` candidate settings on the last `share` of its rows' time, fitted again on all
    its rows: the fit with its settings, the model, and the average precision of the best and of the default."""
    from . import metrics

    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    rows = {f.name: F.lit(True) if f.rows is None else f.rows for f in fits}
    cuts = df.agg(*(F.percentile_approx(F.when(rows[f.name], F.col(time)), 1 - share, 100_000) for f in fits)).first()
    tries = [(f, k, s, rows[f.name] & (F.col(time) < cut), rows[f.name] & (F.col(time) >= cut)) for f, cut in zip(fits, cuts, strict=True) if cut is not None for k, s in enumerate(candidates(count))]
    early = fit_all(df, [replace(f, name=f"{f.name} {k}", rows=a, settings={**f.settings, **s}) for f, k, s, a, _ in tries], order)
    late = {f"{f.name} {k}": b for f, k, _, _, b in tries}
    scored = score_all(df, early, [*order, *{f.label for f in fits}], late)
    long = scored.select(*order, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f.label).cast("int").alias("y"), F.col(f"`{n}`").alias("p")) for n, (f, _) in early.items()))).alias("s")).select(*order, "s.*").where("p IS NOT NULL") if early else None
    got = {r["name"]: r["average_precision"] for r in metrics.average_precisions(long, ["name"], "y", "p", order).collect()} if early else {}
    best = {}
    for f in fits:
        own = [(got.get(f"{f.name} {k}"), k, s) for g, k, s, _, _ in tries if g.name == f.name]
        value, _, s = max(own, key=lambda x: (x[0] if x[0] is not None else -1.0, -x[1]), default=(None, 0, {}))
        best[f.name] = (replace(f, settings={**f.settings, **s}), value, own[0][0] if own else None)
    return {n: (*m, best[n][1], best[n][2]) for n, m in fit_all(df, [b[0] for b in best.values()], order).items()}
