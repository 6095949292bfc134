"""Studies that put the operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, causality, decay, features, hawkes, labels, marks, metrics, trees
from ..operators.ordered import bucket_of, last_known
from ..sources import files

M0 = ["ofi", "micro_minus_mid", "spread", "bid_qty", "ask_qty", "bid_qty_rank", "ask_qty_rank"]
COUNTS = [decay.name_of(c, b) for b in decay.BETAS for c in decay.CODES]
#: In the order of a fit's alpha: source by source.
STATES = [decay.name_of(c, b) for c in decay.CODES for b in decay.BETAS]
MARKS = [decay.name_of(c, b, True) for b in decay.BETAS for c in (8, 9)]
KEY = ["symbol", "tick"]
DAY = 1440
DEALT = 2_000_000  # sampled events whose states one job of window_fits() deals out, 500 bytes each; of times and types ten times as many
HORIZONS, DEPLETIONS = (2, 10, 40), (0.25, 0.5, 0.75)


def step_function(at: DataFrame, steps: DataFrame, width: int = align.WIDTH) -> DataFrame:
    """at (symbol, tick) with value of the last step (symbol, tick, value) at or before; null values are no steps."""
    s = steps.where("value IS NOT NULL").select("symbol", "tick", F.lit(0).alias("kind"), F.struct("value").alias("v"))
    x = s.unionByName(at.select("symbol", "tick", F.lit(1).alias("kind")), True)
    x = last_known(x, ["symbol"], ["tick", "kind"], "v", "found", bucket_of("tick", width))
    return x.where("kind = 1").select("symbol", "tick", F.col("found.value").alias("value"))


def train_window(df: DataFrame, time: str, test: int, width: int) -> DataFrame:
    """Rows of the `width` before the boundary, which lies `test` before the last row."""
    boundary = df.agg(F.max(time)).first()[0]
    if boundary is None:
        return df.limit(0)
    boundary -= test
    return df.where((F.col(time) >= boundary - width) & (F.col(time) < boundary))


def matrix(book: DataFrame, trades: DataFrame, horizons=(10,), depletions=(0.5,), rule: str = "trades_first", extra: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features of the valid samples with day, labels and decayed counts (and, with extra, marked counts and the regime),
    and the aligned stream; both as written tables."""
    with files.tidy(book.sparkSession):
        events = files.staged(align.aligned(book, trades, rule), "aligned")
        x = files.staged(features.l1_features(book), "features")  # as one plan, all parts of the matrix would fill the driver
        x = x.join(labels.labels(features.as_of(x.select(*KEY), book), book, list(horizons), list(depletions)), KEY)
        x = x.join(decay.sampled(events, features.grid(book, lead=3)), KEY)
        if extra:
            x = with_marks_and_regime(files.staged(x, "states"), book, trades, events=events)
        x = x.withColumn("day", F.expr(f"tick div {DAY}"))
        return files.write_features(x, files.shared_path(book.sparkSession, "matrix"), label_names(horizons, depletions)), events


def label_names(horizons, depletions) -> list[str]:
    return [f"a_h{h}" for h in horizons] + [f"b_x{round(100 * d)}_h{h}" for h in horizons for d in depletions]


def with_marks_and_regime(x: DataFrame, book: DataFrame, trades: DataFrame, width: int = DAY, events: DataFrame | None = None) -> DataFrame:
    """x with MARKS, the states of trades weighed by their relative size, and regime, the radius of the last finished
    window (null before the first)."""
    events = align.aligned(book, trades) if events is None else events
    size = marks.trade_size_marks(trades).select("symbol", F.col("id").alias("source_id"), F.lit("trades").alias("source"), "mark")
    sized = events.where("event_code >= 8").join(size, ["symbol", "source", "source_id"]).select("symbol", "event_time", "event_code", "mark")
    states = decay.sampled(files.staged(sized, "sized"), features.grid(book, lead=3), decay.BETAS, (8, 9), "mark")
    radius = step_function(x.select(*KEY), files.staged(regime(events, width), "regime")).withColumnRenamed("value", "regime")
    return x.join(states, KEY).join(radius, KEY)


def within(window: tuple[int, int]):
    return (F.col("tick") >= window[0]) & (F.col("tick") < window[1])


def windowed(x: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """x with window: each row once for each of the windows of ticks [start, end) that hold it."""
    inside = F.array(*(F.when(within(t), F.lit(w)) for w, t in windows.items()))
    return x.withColumn("window", F.explode(F.filter(inside, lambda w: w.isNotNull())))


def taught(x: DataFrame, windows: dict[str, tuple[int, int]], targets: list[str]) -> dict[str, tuple[int, int]]:
    """The windows in which some target shows both labels. The others make no model, so nothing need be fitted to them."""
    if not windows:
        return {}
    both = [F.count_if(F.col(y) == 1).between(1, F.count("*") - 1) for y in targets]
    found = windowed(x, windows).groupBy("window").agg(F.greatest(*both, F.lit(False)).alias("both")).where("both").collect()  # a row a window
    return {w: windows[w] for w in windows if w in {r["window"] for r in found}}


def dealt(x: DataFrame, most: int | None, limit: int | None = None) -> list[list[str]]:
    """The symbols of x in groups whose samples of `most` events (None: all) have `limit` rows together; one that has more is alone."""
    n = x.groupBy("symbol", "event_code").agg((F.count("*") if most is None else F.least(F.count("*"), F.lit(max(1, most // 10)))).alias("n"))
    limit = limit or (10 * DEALT if most is None else DEALT)
    out, room = [], 0
    for r in n.groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect():  # a row a symbol
        if r["n"] > room:
            out.append([])
            room = limit
        out[-1].append(r["symbol"])
        room -= r["n"]
    return out


def window_fits(events: DataFrame, windows: dict[str, tuple[int, int]], most) -> dict[str, dict]:
    """For each window of ticks [start, end), by symbol, the base rates and the matrix of weights of a fit to its events.

    A window of a symbol is a symbol of its own, so a job fits as many as DEALT allows, and what it has shuffled goes
    before the next. most: sampled events of a window, or such numbers by window; None fits to all events.
    """
    out: dict[str, dict] = {w: {} for w in windows}
    sizes = most if isinstance(most, dict) else dict.fromkeys(windows, most)
    fit = lambda e, size, n: hawkes.fit(e, size) if size else hawkes.fit_whole(e.repartition(min(2000, 4 * n), "symbol"))
    for size in dict.fromkeys(sizes.values()):
        own = {w: t for w, t in windows.items() if sizes[w] == size}
        x = windowed(events, own).withColumn("symbol", F.concat("window", F.lit("|"), "symbol"))
        x = files.staged(x.select("symbol", "event_time", "tick", "event_code"), "windows")
        with files.tidy(x.sparkSession):
            made = [r for some in dealt(x, size) for r in fit(x.where(F.col("symbol").isin(some)), size, len(some)).collect()]
        for r in made:  # ten rows a window and symbol
            window, symbol = r["symbol"].split("|", 1)
            mu, alpha = out[window].setdefault(symbol, ([0.0] * 10, [[0.0] * len(STATES) for _ in range(10)]))
            mu[r["target"]], alpha[r["target"]] = r["mu"], list(r["alpha"])
    return out


def ladder(name: str, label: str, rows, rates: dict | None, rounds: int, models=("m0", "m1", "m2", "m3"), **settings) -> list[trees.Fit]:
    """The fits of m0 (book), m1 (and decayed counts), m2 (book and intensities) and m3 (m1 with marked counts and the
    regime; m3r and m3k with only the regime, only the marked counts)."""
    own = {"m0": M0, "m1": M0 + COUNTS, "m2": M0, "m3": M0 + COUNTS + MARKS + ["regime"], "m3r": M0 + COUNTS + ["regime"], "m3k": M0 + COUNTS + MARKS}
    return [trees.Fit(f"{m} {name}", own[m], label, rows, rounds, settings, (STATES, rates) if m == "m2" else None) for m in models]


def wants_extra(models) -> bool:
    """Whether some of the ladder's models has marked counts or the regime among its features."""
    return any(m.startswith("m3") for m in models)


def quality(scored: DataFrame, models: dict, y: str) -> DataFrame:
    """A row per model: its first and second name, n, prevalence, brier, log_loss and pr_auc of its scores."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("p")) for n in models)))
    x = files.staged(scored.select(*KEY, F.col(y).cast("int").alias("y"), each.alias("s")).select(*KEY, "y", "s.*").where("p IS NOT NULL"), "scores")
    plain = x.groupBy("name").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"), metrics.brier(F.col("y"), F.col("p")).alias("brier"), F.avg(metrics.log_loss(F.col("y"), F.col("p"))).alias("log_loss"))
    ap = metrics.average_precisions(x, ["name"], "y", "p", ["tick", "symbol"]).select("name", F.col("average_precision").alias("pr_auc"))
    return plain.join(ap, "name").withColumn("model", F.substring_index("name", " ", 1)).withColumn("part", F.substring_index("name", " ", -1)).drop("name")


def budget_windows(x: DataFrame, budgets, test: int) -> tuple[int, dict[str, tuple[int, int]]]:
    """The first tick of the test, and the training window of each budget of ticks before it."""
    start = x.agg(F.max("tick")).first()[0] - test
    return start, {str(w): (start - w, start) for w in budgets}


CURVE = "model string, budget long, n long, prevalence double, brier double, log_loss double, pr_auc double"


def learning_curve(book: DataFrame, trades: DataFrame, budgets, label: str = "a_h10", test: int = DAY * 5, rounds: int = 160, most: int | None = 100_000, models=("m0", "m1", "m2", "m3"), tune: int = 0) -> DataFrame:
    """A row per budget of training time and model, scored on the last `test` ticks: model, budget, n, prevalence, brier,
    log_loss, pr_auc. A budget whose rows show one label has no row.

    most: sampled events of a Hawkes fit; None scales it with the budget, from 100,000 for the smallest. tune: candidate
    settings of each model, judged on the last part of its training rows; with it, base (the default's score there) and
    best stand beside.
    """
    x, events = matrix(book, trades, extra=wants_extra(models))
    if x.isEmpty():
        return book.sparkSession.createDataFrame([], CURVE)
    y = f"target_{label}"
    start, windows = budget_windows(x, budgets, test)
    windows = taught(x, windows, [y])
    sizes = {w: most or 100_000 * max(1, round((z - a) / min(budgets))) for w, (a, z) in windows.items()}
    rates = window_fits(events, windows, {w: min(n, 5_000_000) for w, n in sizes.items()}) if "m2" in models else dict.fromkeys(windows)
    fits = [f for w, t in windows.items() for f in ladder(w, y, within(t), rates[w], rounds, models)]
    made = trees.tuned(x, fits, "tick", KEY, tune) if tune else trees.fit_all(x, fits, KEY)
    if not made:
        return book.sparkSession.createDataFrame([], CURVE)
    models_ = {n: m[:2] for n, m in made.items()}
    out = quality(trees.score_all(x.where(F.col("tick") >= start), models_, [*KEY, y]), models_, y)
    out = out.select("model", F.col("part").cast("long").alias("budget"), "n", "prevalence", "brier", "log_loss", "pr_auc")
    if tune:
        found = book.sparkSession.createDataFrame([(n.split()[0], int(n.split()[1]), m[3], m[2]) for n, m in made.items()], "model string, budget long, base double, best double")
        out = out.join(found, ["model", "budget"])
    return out


def folds_of(x: DataFrame, training_days: int) -> dict[str, tuple[int, int]]:
    """The training window of each day that has so many days before it."""
    days = sorted(r[0] for r in x.select("day").distinct().collect())  # a row per day
    return {str(d): ((d - training_days) * DAY, d * DAY) for d in days[training_days:]}


def walk_forward(book: DataFrame, trades: DataFrame, training_days: int, label: str = "a_h10", rounds: int = 120, most: int | None = None, models=("m0", "m1", "m2", "m3"), path: str | None = None) -> DataFrame:
    """symbol, tick, day, y and a forecast per model: of each day by models of all rows of the days before it, and Hawkes fits
    to all their events (or to `most` sampled ones).

    Folds are kept under `path`, one per day; a day that is there is read and not made again. A day before which the
    rows show one label has no forecasts.
    """
    spark = book.sparkSession
    path = path or files.shared_path(spark, "folds")
    x, events = matrix(book, trades, extra=wants_extra(models))
    y = f"target_{label}"
    kind = "symbol string, tick bigint, day bigint, y int, " + ", ".join(f"{m} double" for m in models)
    folds = {d: t for d, t in folds_of(x, training_days).items() if not files.exists(spark, f"{path}/forecast_day={d}")}
    folds = taught(x, folds, [y])
    if folds:
        rates = window_fits(events, folds, most) if "m2" in models else dict.fromkeys(folds)
        with files.tidy(spark):
            made = trees.fit_all(x, [f for d, t in folds.items() for f in ladder(d, y, within(t), rates[d], rounds, models)], KEY, None)
        scored = trees.score_all(x.where(F.col("day").isin([int(d) for d in folds])), made, [*KEY, "day", y], {n: F.col("day") == int(n.split()[1]) for n in made})
        own = {m: F.coalesce(F.lit(None).cast("double"), *(F.col(f"`{n}`") for n in made if n.startswith(m + " "))) for m in models}
        out = scored.select(*KEY, "day", F.col(y).alias("y"), *(c.alias(m) for m, c in own.items())).where(" AND ".join(f"{m} IS NOT NULL" for m in models))
        out.withColumn("forecast_day", F.col("day")).repartition("forecast_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("forecast_day").parquet(path)
    if not files.has_parts(spark, path, "forecast_day"):
        return spark.createDataFrame([], kind)
    return files.with_columns(spark.read.parquet(path), [*KEY, "day", "y", *models], path)


def marks_tested(book: DataFrame, trades: DataFrame, training_days: int, label: str = "a_h10", models=("m1", "m3", "m3r")) -> DataFrame:
    """A row per variant of m3: the test of equal predictive ability of m1 and it, on rolling forecasts."""
    x = files.staged(walk_forward(book, trades, training_days, label, models=models), "forecasts")
    loss = lambda m: metrics.log_loss(F.col("y"), F.col(m))
    rows = [(m, *metrics.giacomini_white(x, F.expr("tick div 60"), loss("m1"), loss(m)).values()) for m in models[1:]]
    return book.sparkSession.createDataFrame(rows, "model string, blocks long, mean double, statistic double, p_value double")


def tie_sensitivity(book: DataFrame, trades: DataFrame, most: int = 100_000) -> DataFrame:
    """How each symbol's gamma changes, by block, when the other feed stands first in shared ticks, typing included."""
    a, b = (hawkes.gamma(hawkes.fit(files.staged(align.aligned(book, trades, r), "aligned"), most)) for r in align.RULES)
    return causality.gamma_change(a, b, ["symbol"])


def order_only(book: DataFrame, trades: DataFrame, most: int = 100_000) -> DataFrame:
    """The same when only the order changes; and, as masked, with states that ignore the other feed in mixed ticks."""
    from ..sources.feeds import TOUCH

    events = files.staged(align.aligned(book, trades), "aligned")
    turned = files.staged(causality.quotes_first(events), "turned")
    change = lambda masked: causality.gamma_change(*(hawkes.gamma(hawkes.fit(e, most, masked=masked)) for e in (events, turned)), ["symbol"])
    return change(None).withColumn("states", F.lit("ordered")).unionByName(change(TOUCH).withColumn("states", F.lit("masked")))


def label_grid(book: DataFrame, trades: DataFrame, horizons=HORIZONS, depletions=DEPLETIONS, rounds: int = 160, test: int = DAY * 5, most: int = 100_000, training_days: int | None = None) -> DataFrame:
    """A row per label: days, the mean difference of the log losses of m2 and m1, and its stepdown p-value over all labels.

    Static: models of all rows before the last `test` ticks, scored on these. With training_days, models of so many days
    before each day, scored on it. The Hawkes fits of a window serve all labels.
    """
    x, events = matrix(book, trades, horizons, depletions)
    kind = "label string, days long, gain double, p_value double"
    if x.isEmpty():
        return book.sparkSession.createDataFrame([], kind)
    if training_days is None:
        start = x.agg(F.max("tick")).first()[0] - test
        windows, held = {"all": (0, start)}, {"all": F.col("tick") >= start}
    else:
        windows = folds_of(x, training_days)
        held = {d: F.col("day") == int(d) for d in windows}
    specs = label_names(horizons, depletions)
    windows = taught(x, windows, [f"target_{s}" for s in specs])
    rates = window_fits(events, windows, most)
    fits = [f for w, t in windows.items() for s in specs for f in ladder(f"{s} {w}", f"target_{s}", within(t), rates[w], rounds, ("m1", "m2"))]
    made = trees.fit_all(x, fits, KEY)
    scored = trees.score_all(x, made, [*KEY, "day", *(f"target_{s}" for s in specs)], {n: held[n.split()[2]] for n in made})
    loss = lambda m, s: F.coalesce(F.lit(None).cast("double"), *(metrics.log_loss(F.col(f"target_{s}"), F.col(f"`{n}`")) for n in made if n.startswith(f"{m} {s} ")))
    done = [s for s in specs if any(n.startswith(f"m1 {s} ") for n in made)]
    if not done:
        return book.sparkSession.createDataFrame([], kind)
    d = files.staged(scored.select("day", *((loss("m2", s) - loss("m1", s)).alias(s) for s in done)).where(" AND ".join(f"{s} IS NOT NULL" for s in done)), "differences")
    means = d.agg(F.countDistinct("day").alias("days"), *(F.avg(s).alias(s) for s in done)).first()
    p = metrics.romano_wolf(d, "day", done)
    return book.sparkSession.createDataFrame([(s, means["days"], means[s], p[s]) for s in done], kind)


def marked_fit(events: DataFrame, trades: DataFrame, most: int = 100_000) -> DataFrame:
    """A fit with plain states and, beside them, states in which trades count by their size relative to the median before."""
    size = marks.trade_size_marks(trades).select("symbol", F.col("id").alias("source_id"), F.lit("trades").alias("source"), "mark")
    x = events.join(size, ["symbol", "source", "source_id"], "left").withColumn("mark", F.coalesce("mark", F.lit(1.0)))
    return hawkes.fit(files.staged(x, "marked"), most, mark="mark")


def regime(events: DataFrame, width: int = 1440) -> DataFrame:
    """symbol, tick, value: the radius of each window, known from the window's end on."""
    r = hawkes.windowed_radius(events, width)
    return r.select("symbol", (F.col("start") + width).alias("tick"), F.col("radius").alias("value"))


def transfer(events: DataFrame, source: str, most: int = 100_000) -> DataFrame:
    """Base rates of every symbol under the alpha fitted on one."""
    fits = hawkes.fit(events.where(F.col("symbol") == source), most).drop("symbol")
    spread = events.select("symbol").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(9)))).join(fits, "target")
    return hawkes.profiled(events, files.small(spread, "spread"), most)
