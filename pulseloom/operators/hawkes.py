"""Multivariate point-process models with sums of exponential kernels.

The intensity of type i is mu_i + sum over sources j and scales p of alpha_ijp * z_jp, with z the decayed counts.
The ten types are independent convex problems. In fit() their inputs are a sample of events with states and inverse
sampling weights, and compensators that one aggregation over all events gives; each type is fitted in its own task.
fit_whole() takes all events; a symbol is one task there, which makes the states itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import small
from .align import UNIT
from .decay import BETAS, CODES, before_events, before_events_masked, name_of

FLOOR = 1e-9
FIT = "target int, mu double, alpha array<double>, loglik double, converged boolean, n long"


LOWEST = -(2.0**63)  # of a 64-bit hash
SLAB = 20_000  # events whose states fit_whole() makes at a time, at 50 states 8 MB
KEPT = 500_000  # events of a type whose states a task keeps, 200 MB; those of more are made anew in each pass


def drawn(events: DataFrame, most: int, seed: int = 7) -> tuple[DataFrame, Column]:
    """events with stratum (how many of the symbol and code there are), and which of them a sample takes: of each (symbol,
    code) the most // 10 that come first by a hash; all, if there are no more.

    What is ranked are the few rows whose hash is low enough to be in question; the last of them bounds the sample.
    """
    k = max(1, most // 10)
    h = F.xxhash64("symbol", "event_time", "event_code", F.lit(seed))
    n = small(events.groupBy("symbol", "event_code").agg(F.count("*").alias("stratum")), "strata")  # ten rows a symbol
    low = events.select("symbol", "event_code", h.alias("h")).join(n, ["symbol", "event_code"])
    low = low.where(F.col("h") <= LOWEST + 2.0**64 * F.least(F.lit(1.0), F.lit(k * 1.1 + 100) / F.col("stratum")))
    place = F.row_number().over(Window.partitionBy("symbol", "event_code").orderBy("h"))
    cut = low.withColumn("r", place).where(f"r <= {k}").groupBy("symbol", "event_code").agg(F.max("h").alias("__cut"))
    return events.join(small(n.join(cut, ["symbol", "event_code"]), "cuts"), ["symbol", "event_code"]), h <= F.col("__cut")


def stratified(events: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """The sample of drawn(), with stratum."""
    x, taken = drawn(events, most, seed)
    return x.where(taken).drop("__cut")


def spans(events: DataFrame, unit: int = UNIT) -> DataFrame:
    """symbol, first and end (its first and last event's times) and span in ticks."""
    return events.groupBy("symbol").agg(F.min("event_time").alias("first"), F.max("event_time").alias("end")).withColumn("span", (F.col("end") - F.col("first")) / unit)


def compensators(events: DataFrame, end: int | None = None, betas=BETAS, codes=CODES, weight: str | None = None, unit: int = UNIT) -> DataFrame:
    """symbol, source, scale, c: the integral of the decayed counts to `end` (each symbol's last event by default)."""
    last = small(spans(events).select("symbol", "end") if end is None else events.select("symbol").distinct().withColumn("end", F.lit(end).cast("long")), "ends")
    x = events.join(last, "symbol")
    age = (F.col("end") - F.col("event_time")) / unit
    w = F.col(weight) if weight else F.lit(1.0)
    sums = x.groupBy("symbol", F.col("event_code").alias("source")).agg(*(F.sum(w * (1 - F.exp(-b * age)) / b).alias(f"c{p}") for p, b in enumerate(betas)))
    return sums.select("symbol", "source", F.inline(F.array(*(F.struct(F.lit(p).alias("scale"), F.col(f"c{p}").alias("c")) for p in range(len(betas))))))


def solve(x: np.ndarray | Callable[[], Iterator[np.ndarray]], weight: float, c: np.ndarray, span: float, l2: float = 1e-6, steps: int = 200) -> tuple[float, np.ndarray, float, bool]:
    """mu and alpha (at least FLOOR) that minimise mu T + c.alpha - weight * sum ln(mu + x.alpha) + l2 |alpha|^2 / 2.

    Projected Newton steps on the scaled variables; those at their bound with a gradient against it stay there. x: a matrix,
    or what gives its rows in parts, each time anew.
    """
    parts = x if callable(x) else lambda: (x,)
    n, total = 0, np.zeros(len(c))
    for part in parts():
        n, total = n + len(part), total + part.sum(0)
    scale = np.maximum(np.concatenate([[1.0], total / n]) if n else np.ones(1 + len(c)), 1.0)
    scaled = lambda: (np.hstack([np.ones((len(part), 1)), part]) / scale for part in parts())
    if not callable(x):
        whole = list(scaled())
        scaled = lambda: whole
    lin = np.concatenate([[span], c]) / scale
    pen = l2 / scale**2
    pen[0] = 0
    theta = np.full(len(lin), max(FLOOR, 1e-7))
    theta[0] = max(FLOOR, 0.5 * weight * n / max(span, 1e-12))

    def value(t):
        return lin @ t - weight * sum(np.log(np.maximum(a @ t, 1e-300)).sum() for a in scaled()) + 0.5 * pen @ (t * t)

    now, done = value(theta), False
    for _ in range(steps):
        grad = lin - weight * sum((a / (a @ theta)[:, None]).sum(0) for a in scaled()) + pen * theta
        free = ~((theta <= FLOOR) & (grad > 0))
        if not free.any() or np.abs(grad[free]).max() < 1e-7 * max(1.0, np.abs(lin).max()):
            done = True
            break
        hess = sum(weight * b.T @ b for b in (a[:, free] / (a @ theta)[:, None] for a in scaled())) + np.diag(pen[free])
        hess += 1e-10 * np.trace(hess) / len(hess) * np.eye(len(hess))
        step = np.zeros_like(theta)
        step[free] = np.linalg.solve(hess, -grad[free])
        size = 1.0
        while size > 1e-10:
            new = np.maximum(FLOOR, theta + size * step)
            got = value(new)
            if got <= now + 1e-4 * grad @ (new - theta):
                break
            size /= 2
        else:
            done = True
            break
        if now - got <= 1e-9 * max(1.0, abs(now)):
            theta, now, done = new, got, True
            break
        theta, now = new, got
    alpha = theta[1:] / scale[1:]
    return float(theta[0] / scale[0]), alpha, float(-value(theta)), done


def sample_states(events: DataFrame, most: int, betas=BETAS, unit: int = UNIT, mark: str | None = None, masked=None) -> DataFrame:
    """symbol, event_time, target, stratum and x (the states just before it, 10 sources times the scales, then the marked
    ones) of a sample. Only sampled events leave the windows that make states; masked: see before_events_masked()."""
    drawn_, taken = drawn(events, most)
    names = [name_of(j, b) for j in CODES for b in betas]
    x = before_events_masked(drawn_, masked, betas, keep=taken) if masked else before_events(drawn_, betas, unit=unit, keep=taken)
    if mark:
        marked = before_events(drawn_, betas, weight=mark, unit=unit, keep=taken)
        own = [name_of(j, b, True) for j in CODES for b in betas]
        x, names = x.join(marked.select("symbol", "event_time", *own), ["symbol", "event_time"]), names + own
    return x.select("symbol", "event_time", F.col("event_code").alias("target"), "stratum", F.array(*names).alias("x"))


def every_target(symbols: DataFrame) -> DataFrame:
    """symbols with a row for each of the ten types as target."""
    return symbols.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(9))))


def fit(events: DataFrame, most: int = 100_000, betas=BETAS, l2: float = 1e-6, unit: int = UNIT, mark: str | None = None, masked=None) -> DataFrame:
    """symbol, target, mu, alpha (10 sources times the scales, source by source), loglik, converged, n: a fit for each type.

    Types without events get mu at its floor. mark: a column of weights; the states weighted by it stand beside the
    plain ones, with alpha_mark of their own. masked: codes of touch moves, for states that ignore the other feed.
    """
    plain = len(CODES) * len(betas)
    comp = compensators(events, None, betas, CODES, None, unit)
    if mark:
        comp = comp.unionByName(compensators(events, None, betas, CODES, mark, unit).withColumn("source", F.col("source") + len(CODES)))
    vector = comp.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct((F.col("source") * len(betas) + F.col("scale")).alias("k"), "c"))).alias("c"))
    sides = every_target(spans(events, unit).select("symbol", "span").join(vector, "symbol"))  # ten rows a symbol
    rows = sides.join(sample_states(events, most, betas, unit, mark, masked).drop("event_time"), ["symbol", "target"], "left")

    def run(key, pdf):
        import pandas as pd

        some = pdf[pdf["x"].notna()]
        size = plain * 2 if mark else plain
        x = np.array(some["x"].tolist(), float).reshape(len(some), size)
        at = dict(pdf["c"].iloc[0])
        c = np.array([at.get(i, 0.0) for i in range(size)])
        weight = float(some["stratum"].iloc[0]) / len(some) if len(some) else 0.0
        mu, alpha, loglik, done = solve(x, weight, c, float(pdf["span"].iloc[0]), l2)
        out = pd.DataFrame([(key[0], int(key[1]), mu, alpha[:plain].tolist(), loglik, done, len(some))], columns=["symbol", "target", "mu", "alpha", "loglik", "converged", "n"])
        return out.assign(alpha_mark=[alpha[plain:].tolist()]) if mark else out

    return rows.groupBy("symbol", "target").applyInPandas(run, "symbol string, " + FIT + (", alpha_mark array<double>" if mark else ""))


def states_before(at: np.ndarray, code: np.ndarray, target: int, rates: np.ndarray) -> Iterator[np.ndarray]:
    """In parts, the states (ten sources times the rates) just before each event of a type; at: ascending times in ticks.

    As in decay.scan() a running sum within a block of time, over which the fastest rate takes exp(600) at most, and what
    came before, decayed.
    """
    z, i = np.zeros((len(CODES), len(rates))), 0
    while i < len(at):
        end = min(i + SLAB, int(np.searchsorted(at, at[i] + 600 / rates.max(), "right")))
        grown, own = np.exp((at[i:end, None] - at[i]) * rates), code[i:end]
        rows = np.flatnonzero(own == target)
        x = np.empty((len(rows), len(CODES), len(rates)))
        for j in CODES:
            on = own == j
            sums = np.vstack([z[j], z[j] + np.cumsum(grown[on], 0)])
            x[:, j] = sums[(np.cumsum(on) - on)[rows]]
            z[j] = sums[-1]
        if len(rows):
            yield (x / grown[rows, None]).reshape(len(rows), -1)
        if end < len(at):
            z *= np.exp(-rates * (at[end] - at[i]))
        i = end


def joined(parts: Iterator[np.ndarray]) -> list[np.ndarray]:
    """The rows of parts in fewer of them, of SLAB rows or some more."""
    out, some = [], []
    for part in parts:
        some.append(part)
        if sum(map(len, some)) >= SLAB:
            out, some = [*out, np.vstack(some)], []
    return [*out, np.vstack(some)] if some else out


def fit_whole(events: DataFrame, betas=BETAS, l2: float = 1e-6, unit: int = UNIT) -> DataFrame:
    """The columns of fit(), of fits to all events.

    A symbol is one task: it gets the times and types of the symbol's events, about 50 bytes each while it sorts them, and
    makes the states itself, so they are neither shuffled nor, for types of more than KEPT events, all in memory.
    """
    rates = np.asarray(betas, float)

    def run(key, table):
        import pyarrow as pa

        time, code = (table.column(c).to_numpy() for c in ("event_time", "event_code"))
        order = np.argsort(time, kind="stable")
        at, code = (time[order] - time[order[0]]) / unit, code[order].astype(np.int8)
        c = np.stack([np.bincount(code, (1 - np.exp(-b * (at[-1] - at))) / b, len(CODES)) for b in rates], 1).ravel()
        out = []
        for i, n in enumerate(np.bincount(code, minlength=len(CODES)).tolist()):
            make = lambda i=i: states_before(at, code, i, rates)
            x = make
            if n <= KEPT:
                held = joined(make())
                x = held[0] if len(held) == 1 else (lambda held=held: held)
            mu, alpha, loglik, done = solve(x, 1.0, c, float(at[-1]), l2)
            held = x = None  # before the next are made
            out.append({"symbol": key[0].as_py(), "target": i, "mu": mu, "alpha": alpha.tolist(), "loglik": loglik, "converged": bool(done), "n": n})
        kinds = [("symbol", pa.string()), ("target", pa.int32()), ("mu", pa.float64()), ("alpha", pa.list_(pa.float64())), ("loglik", pa.float64()), ("converged", pa.bool_()), ("n", pa.int64())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return events.select("symbol", "event_time", "event_code").groupBy("symbol").applyInArrow(run, "symbol string, " + FIT)


def gamma(fits: DataFrame, betas=BETAS) -> DataFrame:
    """symbol, target, source, value: the expected number of direct children, alpha over beta summed over scales."""
    x = fits.select("symbol", "target", F.posexplode("alpha").alias("k", "a"))
    n = len(betas)
    rate = F.element_at(F.array(*map(F.lit, betas)), (F.col("k") % n + 1).cast("int"))
    return x.groupBy("symbol", "target", F.expr(f"k div {n}").cast("int").alias("source")).agg(F.sum(F.col("a") / rate).alias("value"))


def spectral_radius(matrix: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(matrix)).max())


def stationary(fits: DataFrame, most: float = 0.995, betas=BETAS) -> DataFrame:
    """fits with radius (of gamma), shrink (the factor that brings it to `most` at most) and alpha multiplied by it."""

    def run(key, pdf):
        a = np.zeros((10, len(CODES), len(betas)))
        for t, x in zip(pdf["target"], pdf["alpha"], strict=True):
            a[t] = np.asarray(x).reshape(len(CODES), len(betas))
        radius = spectral_radius((a / np.asarray(betas)).sum(2))
        shrink = min(1.0, most / radius) if radius > 0 else 1.0
        return pdf.assign(alpha=[(np.asarray(x) * shrink).tolist() for x in pdf["alpha"]], radius=radius, shrink=shrink)

    schema = StructType(list(fits.schema.fields)).add("radius", "double").add("shrink", "double")
    return fits.groupBy("symbol").applyInPandas(run, schema)


def intensity(states: DataFrame, mu: list[float], alpha: list[list[float]], betas=BETAS) -> dict:
    """Columns hawkes_lambda_<i>: linear in the states, at least 1e-12."""
    names = [name_of(j, b) for j in CODES for b in betas]
    out = {}
    for i, (m, a) in enumerate(zip(mu, alpha, strict=True)):
        total = F.lit(float(m))
        for n, w in zip(names, a, strict=True):
            if w:
                total = total + F.col(n) * float(w)
        out[f"hawkes_lambda_{i}"] = F.greatest(total, F.lit(1e-12))
    return out


def loglikelihood(events: DataFrame, mu: list[float], alpha: list[list[float]], betas=BETAS, unit: int = UNIT) -> DataFrame:
    """symbol, target, loglik of given parameters over all events: the sum of ln(intensity) at the type's events less the
    integrals of base rate and excitation."""
    states = before_events(events, betas, unit=unit)
    rate = F.element_at(F.array(*intensity(states, mu, alpha, betas).values()), F.col("event_code") + 1)
    logs = states.groupBy("symbol", F.col("event_code").alias("target")).agg(F.sum(F.ln(rate)).alias("logs"))
    weights = F.array(*(F.array(*map(F.lit, map(float, a))) for a in alpha))
    of = lambda t: F.element_at(F.element_at(weights, t + 1), (F.col("source") * len(betas) + F.col("scale") + 1).cast("int"))
    excitation = compensators(events, None, betas, unit=unit).withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(9)))).groupBy("symbol", "target").agg(F.sum(of(F.col("target")) * F.col("c")).alias("exc"))
    base = F.element_at(F.array(*map(F.lit, map(float, mu))), F.col("target") + 1) * F.col("span")
    x = every_target(spans(events, unit)).join(excitation, ["symbol", "target"], "left").join(logs, ["symbol", "target"], "left")
    return x.select("symbol", "target", (F.coalesce("logs", F.lit(0.0)) - base - F.coalesce("exc", F.lit(0.0))).alias("loglik"))


def seasonal_loglikelihood(events: DataFrame, rate, alpha: list[list[float]], betas=BETAS, tick_seconds: float = 60.0, step: float = 60.0, unit: int = UNIT) -> DataFrame:
    """symbol, target, loglik over all events for a base rate that `rate` makes of seconds since the epoch, without the
    excitation's integral. The rate is summed at midpoints of `step` seconds from the first to the last event."""
    x = before_events(events, betas, unit=unit)
    excess = intensity(x, [0.0] * 10, alpha, betas)
    own = F.element_at(F.array(*excess.values()), F.col("event_code") + 1)
    x = x.groupBy("symbol", F.col("event_code").alias("target")).agg(F.sum(F.ln(F.greatest(rate(F.col("event_time") / unit * tick_seconds) + own, F.lit(1e-12)))).alias("logs"))
    s = spans(events, unit).withColumn("seconds", F.col("span") * tick_seconds)
    grid = s.select("symbol", "seconds", (F.col("first") / unit * tick_seconds).alias("from"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("seconds") / step)).cast("int") - 1)).alias("k"))
    part = F.least(F.lit(step), F.col("seconds") - F.col("k") * step) / tick_seconds
    base = grid.groupBy("symbol").agg(F.sum(rate(F.col("from") + step * (F.col("k") + 0.5)) * part).alias("base"))
    return every_target(base).join(x, ["symbol", "target"], "left").select("symbol", "target", (F.coalesce("logs", F.lit(0.0)) - F.col("base")).alias("loglik"))


def profile_mu(excess: np.ndarray, weight: float, span: float) -> float:
    """The mu that solves sum weight / (mu + e) = span by bisection, for fixed excitations e; FLOOR if that is too much."""
    if not len(excess) or weight * (1 / (FLOOR + excess)).sum() <= span:
        return FLOOR
    low, high = FLOOR, weight * len(excess) / span
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if weight * (1 / (mid + excess)).sum() > span else (low, mid)
    return (low + high) / 2


def excited(events: DataFrame, fits: DataFrame, most: int, betas=BETAS, unit: int = UNIT) -> DataFrame:
    """For each row of fits (symbol, target, alpha): span, and the sampled events' time, stratum and excitation e under
    alpha; one row with nulls for a type without events."""
    own = every_target(spans(events, unit).select("symbol", "first", "span")).join(fits.select("symbol", "target", "alpha"), ["symbol", "target"])
    x = own.join(sample_states(events, most, betas, unit), ["symbol", "target"], "left")
    e = F.aggregate(F.zip_with("x", "alpha", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return x.select("symbol", "target", "first", "span", "event_time", "stratum", e.alias("e"))


def profiled(events: DataFrame, fits: DataFrame, most: int = 100_000, betas=BETAS, unit: int = UNIT) -> DataFrame:
    """symbol, target, mu: the base rates of `events` under the alpha of `fits` (which may come from elsewhere); FLOOR
    for types without events."""

    def run(key, pdf):
        import pandas as pd

        e = pdf["e"].dropna().to_numpy()
        mu = profile_mu(e, float(pdf["stratum"].iloc[0]) / len(e), float(pdf["span"].iloc[0])) if len(e) else FLOOR
        return pd.DataFrame([(key[0], int(key[1]), mu)], columns=["symbol", "target", "mu"])

    return excited(events, fits, most, betas, unit).groupBy("symbol", "target").applyInPandas(run, "symbol string, target int, mu double")


WAVES, EDGES = 16, 6  # columns of features.seasonality(): harmonics, then indicators
LIMITS = np.array([20.0] + [np.inf] * WAVES + [5.0] * EDGES)


def day_design(seconds: np.ndarray) -> np.ndarray:
    """features.seasonality() in NumPy, a row for each of the seconds since the epoch."""
    s = np.mod(seconds, 86_400.0)
    turn = 2 * np.pi * s[:, None] * np.arange(1, WAVES // 2 + 1) / 86_400
    waves = np.stack([np.cos(turn), np.sin(turn)], 2).reshape(len(s), WAVES)
    d = np.mod(s[:, None] - np.array([0, 8, 16]) * 3600.0 + 43_200, 86_400) - 43_200
    return np.hstack([waves, np.stack([(d >= -300) & (d < 0), (d >= 0) & (d <= 300)], 2).reshape(len(s), EDGES)])


def exposure(first: float, span: float, step: float = 60.0) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of the day and how long each stands for, over `span` seconds from `first`: midpoints of steps.

    Steps that share a second of the day are added up, so there are at most as many as a day has.
    """
    n = max(1, int(np.ceil(span / step)))
    k = np.arange(min(n, round(86_400 / step)))
    lasts = step * ((n - 1 - k) // len(k) + 1.0)
    lasts[(n - 1) % len(k)] -= n * step - span  # the last step may end early
    return np.mod(first + step * (k + 0.5), 86_400.0), lasts


def harmonic_rate(theta: np.ndarray, design: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """features.seasonal_rate() of parameters (eta, harmonics, indicators) and its gradient, by rows of the design."""
    pairs = theta[1 : 1 + WAVES].reshape(-1, 2)
    size = np.sqrt((pairs**2).sum(1) + eps)
    tilt = np.exp(np.clip(design[:, WAVES:] @ theta[1 + WAVES :], -20, 20))
    rate = np.maximum((eps + np.exp(theta[0]) + size.sum() + design[:, :WAVES] @ theta[1 : 1 + WAVES]) * tilt, eps)
    return rate, np.column_stack([np.exp(theta[0]) * tilt, tilt[:, None] * (design[:, :WAVES] + (pairs / size[:, None]).ravel()), rate[:, None] * design[:, WAVES:]])


def seasonal_solve(design: np.ndarray, e: np.ndarray, weight: float, grid: np.ndarray, lasts: np.ndarray, mu: float, steps: int = 300) -> tuple[np.ndarray, float, bool]:
    """Parameters that maximise weight * sum ln(rate + e) - integral of the rate, the value, and whether it converged.

    Damped scoring steps from the constant rate mu, with the events' gradients for the curvature; eta within 20 and
    the indicators within 5 of 0.
    """

    def at(t):
        own, d = harmonic_rate(t, design)
        over, dg = harmonic_rate(t, grid)
        lam = np.maximum(own + e, 1e-12)
        scores = d / lam[:, None]
        return weight * np.log(lam).sum() - lasts @ over, weight * scores.sum(0) - lasts @ dg, weight * scores.T @ scores

    theta = np.zeros(1 + WAVES + EDGES)
    theta[0] = np.log(max(mu, 1e-6))
    theta[1 : 1 + WAVES] = 1e-3 * mu  # off the kink at 0, where the scores of a harmonic vanish
    now, grad, curve = at(theta)
    damp = 1e-3
    for _ in range(steps):
        free = ~((np.abs(theta) >= LIMITS) & (np.sign(grad) == np.sign(theta)))
        scale = np.diag(curve) + 1e-9 * max(1.0, np.diag(curve).max())
        move = np.zeros_like(theta)
        move[free] = np.linalg.solve(curve[np.ix_(free, free)] + damp * np.diag(scale[free]), grad[free])
        new = np.clip(theta + move, -LIMITS, LIMITS)
        got = at(new)
        if got[0] > now:
            gain, theta, damp = got[0] - now, new, max(damp / 4, 1e-9)
            now, grad, curve = got
            if gain <= 1e-10 * max(1.0, abs(now)):
                return theta, float(now), True
        else:
            damp *= 8
            if damp > 1e12:
                return theta, float(now), True
    return theta, float(now), False


SEASON = "symbol string, target int, eta double, harmonic array<double>, funding array<double>, loglik double, constant double, converged boolean"


def seasonal_profile(events: DataFrame, fits: DataFrame, tick_seconds: float = 60.0, most: int = 100_000, betas=BETAS, unit: int = UNIT) -> DataFrame:
    """symbol, target, eta, harmonic, funding, loglik, constant, converged: for each row of fits (symbol, target, mu, alpha)
    a daily base rate in place of mu, with the kernels of alpha held, and both likelihoods without the excitation's
    integral, which is the same in both. Types without events keep a constant rate at its floor."""
    x = excited(events, fits, most, betas, unit).join(fits.select("symbol", "target", "mu"), ["symbol", "target"])

    def run(key, pdf):
        import pandas as pd

        some = pdf[pdf["e"].notna()]
        first, span, mu = (float(pdf[c].iloc[0]) for c in ("first", "span", "mu"))
        at, lasts = exposure(first / unit * tick_seconds, span * tick_seconds)
        lasts = lasts / tick_seconds
        if len(some):
            e, w = some["e"].to_numpy(), float(some["stratum"].iloc[0]) / len(some)
            constant = w * np.log(np.maximum(mu + e, 1e-12)).sum() - mu * span
            theta, value, done = seasonal_solve(day_design(some["event_time"].to_numpy() / unit * tick_seconds), e, w, day_design(at), lasts, mu)
        else:
            theta, value, constant, done = np.zeros(1 + WAVES + EDGES), -mu * span, -mu * span, True
            theta[0] = np.log(FLOOR)
        return pd.DataFrame([(key[0], int(key[1]), theta[0], theta[1 : 1 + WAVES].tolist(), theta[1 + WAVES :].tolist(), value, constant, done)], columns=["symbol", "target", "eta", "harmonic", "funding", "loglik", "constant", "converged"])

    return x.groupBy("symbol", "target").applyInPandas(run, SEASON)


def windowed_radius(events: DataFrame, width: int, least: int = 100, known_gaps: DataFrame | None = None, betas=BETAS, unit: int = UNIT) -> DataFrame:
    """symbol, start, n, radius: a fit in every tumbling window of `width` ticks that has `least` events or more.

    The first window of a symbol may be partial and counts, its last is left out. Windows that overlap a known
    gap are left out. Each window is fitted from nothing, in one task.
    """
    from .audits import without_gaps

    x = events.withColumn("start", F.expr(f"floor(event_time / {unit} / {width}) * {width}"))
    last = x.groupBy("symbol").agg(F.max("start").alias("last"))
    sizes = x.groupBy("symbol", "start").agg(F.count("*").alias("n")).join(last, "symbol").where(f"n >= {least} AND start < last").select("symbol", "start", "n", (F.col("start") + width).alias("end"))
    if known_gaps is not None:
        sizes = without_gaps(sizes, known_gaps)
    x = x.join(sizes.select("symbol", "start", "n"), ["symbol", "start"]).select("symbol", "start", "n", "event_time", "event_code")
    rates = np.asarray(betas)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("event_time")
        t, code = pdf["event_time"].to_numpy() / unit, pdf["event_code"].to_numpy()
        z, at, states = np.zeros((10, len(rates))), t[0], np.empty((len(t), 10 * len(rates)))
        for i in range(len(t)):
            z *= np.exp(-rates * (t[i] - at))
            states[i], at = z.ravel(), t[i]
            z[code[i]] += 1
        span = t[-1] - t[0]
        c = np.zeros((10, len(rates)))
        np.add.at(c, code, (1 - np.exp(-rates * (t[-1] - t)[:, None])) / rates)
        g = np.zeros((10, 10))
        for i in range(10):
            if (code == i).any():
                alpha = solve(states[code == i], 1.0, c.ravel(), span)[1]
                g[i] = (alpha.reshape(10, -1) / rates).sum(1)
        return pd.DataFrame([(key[0], int(key[1]), len(t), spectral_radius(g))], columns=["symbol", "start", "n", "radius"])

    return x.groupBy("symbol", "start").applyInPandas(run, "symbol string, start long, n long, radius double")
