"""Operators on small inputs with known answers, invariances, and fits' properties."""

import inspect
import math
import random
from datetime import date

import numpy as np
import pytest
from pulseloom.operators import align, audits, causality, decay, features, hawkes, labels, marks, metrics, trees
from pulseloom.operators.ordered import bucket_of, last_known, previous
from pulseloom.plans import experiments, queries
from pulseloom.sources import feeds, files
from pulseloom.streaming import stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BOOK = "symbol string, update_id long, tick long, bid_price double, bid_qty double, ask_price double, ask_qty double"
TRADES = "symbol string, id long, tick long, price double, qty double, is_buyer_maker boolean"


def book(spark, *rows):
    return spark.createDataFrame([("S", i + 1, *r) for i, r in enumerate(rows)], BOOK)


def trades(spark, *rows):
    return spark.createDataFrame([("S", 100 + i, *r) for i, r in enumerate(rows)], TRADES)


def codes(df):
    return [(r["event_time"], r["event_code"]) for r in df.orderBy("event_time").collect()]


def test_all_types_of_changes(spark):
    b = book(spark, (1, 10.0, 5.0, 11.0, 5.0), (2, 10.0, 6.0, 11.0, 5.0), (3, 10.0, 4.0, 11.0, 5.0), (4, 10.5, 4.0, 11.0, 5.0), (5, 10.0, 4.0, 11.0, 5.0), (6, 10.0, 4.0, 11.0, 7.0), (7, 10.0, 4.0, 11.0, 6.0), (8, 10.0, 4.0, 11.5, 6.0), (9, 10.0, 4.0, 11.0, 6.0), (10, 9.5, 1.0, 12.0, 2.0), (11, 9.5, 1.0, 12.0, 2.0))
    none = trades(spark, (99, 1.0, 1.0, True)).limit(0)
    got = [(r["tick"], r["event_code"], r["volume"]) for r in align.quote_events(align.attributed(align.transitions(b), none)).orderBy("tick", "side").collect()]
    assert got == [(2, 0, 1.0), (3, 1, 2.0), (4, 2, 4.0), (5, 3, 4.0), (6, 4, 2.0), (7, 5, 1.0), (8, 6, 6.0), (9, 7, 6.0), (10, 3, 1.0), (10, 6, 2.0)]


def test_traded_volume_explains_drops(spark):
    b = book(spark, (1, 10.0, 5.0, 11.0, 5.0), (5, 10.0, 3.0, 11.0, 5.0), (9, 10.0, 1.0, 11.0, 5.0))
    t = trades(spark, (5, 10.0, 2.0, True), (6, 10.0, 0.5, True), (1, 10.0, 9.0, True), (20, 10.0, 1.0, False))
    first = align.quote_events(align.attributed(align.transitions(b), t)).collect()
    assert [(r["tick"], r["event_code"], r["volume"]) for r in first] == [(9, 1, 1.5)]
    late = align.quote_events(align.attributed(align.transitions(b), t, "book_first"))
    assert late.count() == 0  # 9.0 at tick 1 explains the drop at 5, 2.0 and 0.5 that at 9
    assert align.explained_drops(align.attributed(align.transitions(b), t)).first()["bid_explained"] == 1
    with pytest.raises(ValueError):
        align.matched_quotes(align.transitions(b), t, "other")


def test_ranks_and_rules(spark):
    b = book(spark, (1, 10.0, 5.0, 11.0, 5.0), (1, 10.0, 6.0, 11.0, 5.0), (2, 10.0, 7.0, 11.0, 6.0))
    t = trades(spark, (1, 11.0, 1.0, False), (2, 10.0, 1.0, True))
    assert codes(align.aligned(b, t)) == [(10000, 8), (10001, 0), (20000, 9), (20001, 0), (20002, 4)]
    assert codes(align.aligned(b, t, "book_first")) == [(10000, 0), (10001, 8), (20000, 0), (20001, 4), (20002, 9)]
    with pytest.raises(Exception, match="too many events"):
        align.merged(align.attributed(align.transitions(b), t), t, most=2).collect()
    stats = align.alignment_stats(b, t).first()
    assert stats["unclassified"] == 0 and stats["trade_buy"] == 1


@pytest.mark.parametrize("width", [3, 60, 10**9])
def test_bucket_width_changes_nothing(spark, width):
    b, t = feeds.derived_book(spark, SF), feeds.derived_trades(spark, SF)
    assert codes(align.aligned(b, t, width=width).where("symbol = 'S0'")) == codes(align.aligned(b.repartition(7), t.orderBy("price")).where("symbol = 'S0'"))


def test_last_known(spark):
    x = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 30, None), ("a", 31, 7), ("b", 40, None)], "s string, t int, v int")
    got = lambda **k: [r["o"] for r in last_known(x, ["s"], ["t"], "v", "o", bucket_of("t", 10), **k).orderBy("s", "t").collect()]
    assert got() == [None, 5, 5, 7, None]
    assert got(strict=True) == [None, None, 5, 5, None]
    assert got(backward=True) == [5, 5, 7, 7, None]
    assert [r["p"] and r["p"]["t"] for r in previous(x, ["s"], ["t"], ["t"], "p", bucket_of("t", 10)).orderBy("s", "t").collect()] == [None, 1, 2, 30, None]


def test_as_of_takes_the_last_of_a_tick(spark):
    b = book(spark, (5, 1.0, 1.0, 2.0, 1.0), (5, 1.0, 9.0, 2.0, 1.0), (2000, 1.0, 3.0, 2.0, 1.0))
    s = spark.createDataFrame([("S", 4), ("S", 5), ("S", 1999), ("S", 2000)], "symbol string, tick long")
    got = [r["quote"] and r["quote"]["bid_qty"] for r in features.as_of(s, b).orderBy("tick").collect()]
    assert got == [None, 9.0, 9.0, 3.0]
    assert [r["next"] and r["next"]["update_id"] for r in features.next_quotes(s, b).orderBy("tick").collect()] == [1, 1, 3, 3]
    assert [r["next"] and r["next"]["update_id"] for r in features.next_quotes(s, b, True).orderBy("tick").collect()] == [1, 3, 3, None]


def test_labels(spark):
    b = book(spark, (0, 10.0, 10.0, 11.0, 10.0), (3, 10.0, 4.0, 11.0, 10.0), (20, 9.5, 4.0, 11.0, 10.0))
    s = features.as_of(spark.createDataFrame([("S", -5), ("S", 0), ("S", 15), ("S", 50)], "symbol string, tick long"), b)
    got = {r["tick"]: (r["a_h10"], r["b_x50_h10"], r["b_x70_h10"]) for r in labels.labels(s, b, [10], [0.5, 0.7]).collect()}
    assert got == {-5: (0, 0, 0), 0: (0, 1, 0), 15: (1, 0, 0), 50: (0, 0, 0)}


def test_order_flow_and_rank(spark):
    b = book(spark, (0, 10.0, 5.0, 11.0, 4.0), (10, 10.0, 7.0, 11.0, 3.0), (20, 10.5, 2.0, 11.0, 9.0))
    s = features.as_of(spark.createDataFrame([("S", 0), ("S", 10), ("S", 20)], "symbol string, tick long"), b)
    assert [r["ofi"] for r in features.order_flow(s).orderBy("tick").collect()] == [0.0, 3.0, -4.0]
    x = spark.createDataFrame([("S", t, v, on) for t, v, on in ((0, 3.0, True), (5, 1.0, True), (6, 9.0, False), (7, 3.0, True), (13, 2.0, True))], "symbol string, tick long, v double, active boolean")
    got = [(r["v_rank"], r["active_count"]) for r in features.rolling_rank(x, ["v"], "active", 8, 8).orderBy("tick").collect()]
    assert got == [(1.0, 1), (0.5, 2), (1.0, 2), (1.0, 3), (2 / 3, 3)]


def test_rolling_median_matches_brute_force(spark):
    rng = random.Random(0)
    rows = [("S", t, i, rng.choice([1.0, 2.0, 3.5, 7.0])) for i, t in enumerate(sorted(rng.randrange(300) for _ in range(200)))]
    x = spark.createDataFrame(rows, "symbol string, tick long, seq long, v double")
    got = [r["median"] for r in marks.rolling_median_before(x, "v", span=20, width=25).orderBy("seq").collect()]
    want = [np.median(w) if (w := [v for _, u, j, v in rows if j < i and u >= t - 20]) else None for _, t, i, _ in rows]
    assert got == want
    t = trades(spark, (1, 1.0, 4.0, True), (2, 1.0, 2.0, True))
    assert [r["mark"] for r in marks.trade_size_marks(t).orderBy("id").collect()] == [1.0, 0.5]


def events(spark, n=60, seed=0, gap=5):
    rng = random.Random(seed)
    tick, rank, rows = 100, 0, []
    for _ in range(n):
        step = rng.randrange(gap)
        tick, rank = tick + step, 0 if step else rank + 1
        rows.append(("S", tick * align.UNIT + rank, tick, rng.randrange(10), rng.random() * 3))
    return rows, spark.createDataFrame(rows, "symbol string, event_time long, tick long, event_code int, w double")


@pytest.mark.parametrize("weighted", [False, True])
def test_decayed_states_match_brute_force(spark, weighted):
    rows, e = events(spark)
    samples = spark.createDataFrame([("S", t) for t in (90, 100, 117, 150, 5000)], "symbol string, tick long")
    for beta in (0.05, 20.0):
        got = decay.sampled(e, samples, (beta,), weight="w" if weighted else None).collect()
        for r in got:
            for c in range(10):
                want = sum((w if weighted else 1) * math.exp(-beta * (r["tick"] * align.UNIT - t) / align.UNIT) for _, t, _, k, w in rows if k == c and t <= r["tick"] * align.UNIT)
                assert r[decay.name_of(c, beta, weighted)] == pytest.approx(want, rel=1e-11, abs=1e-20)
        for r in decay.before_events(e, (beta,), weight="w" if weighted else None).collect():
            want = sum((w if weighted else 1) * math.exp(-beta * (r["event_time"] - t) / align.UNIT) for _, t, _, k, w in rows if k == 3 and t < r["event_time"])
            assert r[decay.name_of(3, beta, weighted)] == pytest.approx(want, rel=1e-11, abs=1e-20)


def test_masked_states_ignore_the_order_of_feeds(spark):
    _, e = events(spark, 80, 4, 3)
    turned = causality.quotes_first(e)
    key = lambda df: sorted((r["tick"], r["event_code"], *(round(r[decay.name_of(c, 0.1)], 9) for c in ((8, 9) if r["event_code"] in feeds.TOUCH else feeds.TOUCH if r["event_code"] >= 8 else ()))) for r in df.collect())
    a, b = (decay.before_events_masked(x, feeds.TOUCH, (0.1,)) for x in (e, turned))
    assert key(a) == key(b)
    assert sorted(r["event_code"] for r in e.collect()) == sorted(r["event_code"] for r in turned.collect())


def test_metrics(spark):
    x = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)])], "id int, p double, y int")
    assert metrics.average_precision(x, "y", "p", ["id"]).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.average_precision(x.where("y = 0"), "y", "p", ["id"]).first()["average_precision"] is None
    a = metrics.alert_metrics(x.withColumn("lead", F.col("id") * 10), "y", "p", "lead", ["id"], 0.5).first()
    assert (a["threshold"], a["alert_rate"], a["recall"], a["median_lead"]) == (0.7, 0.5, 0.5, 0.0)
    assert metrics.two_sided(1.959963984540054) == pytest.approx(0.05) and metrics.two_sided(-2.5758293035489004) == pytest.approx(0.01) and math.isnan(metrics.two_sided(float("nan")))
    loss = x.select(metrics.log_loss(F.col("y"), F.when(F.col("id") > 0, F.col("p"))).alias("l")).collect()
    assert loss[0]["l"] is None and loss[1]["l"] == pytest.approx(-math.log(0.1))
    few = spark.createDataFrame([(1, 0.5), (2, 0.1)], "block long, diff double")
    assert math.isnan(metrics.mean_test(few)["p_value"])
    rng = np.random.default_rng(0)
    d = rng.normal(0.3, 1, 250)
    got = metrics.mean_test(spark.createDataFrame([(i * 3, float(v)) for i, v in enumerate(d)], "block long, diff double"))
    c, n, last = d - d.mean(), len(d), metrics.lag_count(len(d))
    var = c @ c / n + sum(2 * (1 - k / (last + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, last + 1))
    assert got["statistic"] == pytest.approx(d.mean() / math.sqrt(var / n))


def test_romano_wolf(spark):
    rng = np.random.default_rng(2)
    v = np.stack([rng.normal(0, 1, 400), rng.normal(1, 1, 400)], 1)
    day = np.arange(400) // 40
    x = spark.createDataFrame([(int(d), float(a), float(b)) for d, (a, b) in zip(day, v, strict=True)], "day long, a double, b double")
    p = metrics.romano_wolf(x, "day", ["a", "b"], 300, 9)
    draws, c = np.random.default_rng(9).multinomial(10, [0.1] * 10, 300), v - v.mean(0)
    t = lambda x, m=0: np.abs((x.mean(0) + m) / (x.std(0, ddof=1) / math.sqrt(len(x))))
    boot = np.array([t(np.concatenate([c[day == i] for i, n in enumerate(draw) for _ in range(n)])) for draw in draws])
    obs = t(v)
    first, second = (1, 0) if obs[1] > obs[0] else (0, 1)
    p1 = (boot.max(1) >= obs[first]).mean()
    assert p["ab"[first]] == pytest.approx(p1) and p["ab"[second]] == pytest.approx(max(p1, (boot[:, second] >= obs[second]).mean()))


def test_audits(spark):
    t = trades(spark, (0, 10.0, 1.0, True), (5, 11.0, 2.0, True), (1440, 10.0, 1.0, True))
    assert [r["volatility"] for r in audits.daily_summary(t).orderBy("day").collect()] == [pytest.approx(abs(math.log(1.1))), 0.0]
    days = spark.createDataFrame([("S", d, v) for d, v in enumerate([1.0, 1.0, 1.0, 9.0])], "symbol string, day int, v double")
    assert {(r["z"], r["flag"]) for r in audits.robust_z(days, "v", "day < 3").collect()} == {(None, False)}
    known = spark.createDataFrame([(10, 20)], "gap_start long, gap_end long")
    w = spark.createDataFrame([(0, 10), (5, 11), (19, 30), (20, 30)], "start long, end long")
    assert sorted(r["start"] for r in audits.without_gaps(w, known).collect()) == [0, 20]
    g = audits.gaps(t).orderBy("day").first()
    assert (g["n_gaps"], g["longest"]) == (1, 143)


def test_gamma_change_is_zero_for_equal_matrices(spark):
    a, _ = queries.matrices(spark)
    assert {r["change"] for r in causality.gamma_change(a, a).collect()} == {0.0}


def test_solver_and_profile():
    rng = np.random.default_rng(1)
    x = rng.exponential(1, (400, 5))
    c, span = x.sum(0) * 0.9, 300.0
    mu, alpha, loglik, done = hawkes.solve(x, 1.0, c, span)
    assert done and mu > 0 and (alpha > 0).all()
    value = lambda m, a: np.log(m + x @ a).sum() - m * span - a @ c - 5e-7 * a @ a
    assert loglik == pytest.approx(value(mu, alpha))
    for _ in range(50):
        m, a = max(1e-9, mu + rng.normal() * 0.05), np.maximum(1e-9, alpha + rng.normal(size=5) * 0.05)
        assert value(m, a) <= loglik + 1e-6
    assert hawkes.profile_mu(x @ alpha, 1.0, span) == pytest.approx(mu, rel=0.02)
    assert hawkes.profile_mu(np.full(3, 100.0), 1.0, 1.0) == hawkes.FLOOR
    assert hawkes.solve(np.empty((0, 5)), 0.0, c, span)[0] == hawkes.FLOOR


def test_fit_is_stationary(spark):
    rows, e = events(spark, 600, 8)
    fits = hawkes.stationary(hawkes.fit(e, 600, (0.05, 0.5)), 0.5, (0.05, 0.5))
    g = np.zeros((10, 10))
    for r in hawkes.gamma(fits, (0.05, 0.5)).collect():
        g[r["target"], r["source"]] = r["value"]
    assert hawkes.spectral_radius(g) <= 0.5 + 1e-9
    assert fits.first()["shrink"] <= 1 and fits.count() == 10
    assert hawkes.stratified(e, 100).groupBy("event_code").count().agg(F.max("count")).first()[0] == 10


def test_marks_have_their_own_block(spark):
    """Marks of 0 add nothing; marks of 2 give the same likelihood, as states and compensators double alike."""
    _, e = events(spark, 200, 8)
    own = {r["target"]: r for r in hawkes.fit(e, 200, (0.05, 0.5)).collect()}
    for m in (0.0, 2.0):
        for r in hawkes.fit(e.withColumn("mark", F.lit(m)), 200, (0.05, 0.5), mark="mark").collect():
            assert len(r["alpha"]) == len(r["alpha_mark"]) == 20
            assert r["loglik"] == pytest.approx(own[r["target"]]["loglik"], rel=1e-3, abs=1e-2)


def test_marks_that_excite_are_found(spark):
    """Trades of mark 2 are followed by a move of the touch, those of mark 0 by none: the marked block takes it."""
    rng, rows = random.Random(6), []
    for i in range(500):
        mark = rng.choice([0.0, 2.0])
        rows.append(("S", (20 * i + 100) * align.UNIT, 20 * i + 100, 8, mark))
        if mark:
            rows.append(("S", (20 * i + 101) * align.UNIT, 20 * i + 101, 3, 1.0))
    e = spark.createDataFrame(rows, "symbol string, event_time long, tick long, event_code int, mark double")
    r = hawkes.fit(e, 10_000, (0.5,), mark="mark").where("target = 3").first()
    assert r["alpha_mark"][8] > 0.1 and r["alpha_mark"][8] > 20 * r["alpha"][8] and r["n"] == sum(x[3] == 3 for x in rows)


def test_seasonal_gradient_and_exposure():
    """The gradient against differences; five minutes for each indicator and day, and the whole span in sum."""
    rng = np.random.default_rng(4)
    at, lasts = hawkes.exposure(1_000_000 * 86_400 + 1_800, 3 * 86_400)
    assert lasts.sum() == pytest.approx(3 * 86_400)
    grid = hawkes.day_design(at)
    assert (lasts @ grid[:, hawkes.WAVES :]).tolist() == [900.0] * 6
    at, lasts = hawkes.exposure(7.0, 130.0)
    assert at.tolist() == [37.0, 97.0, 157.0] and lasts.tolist() == [60.0, 60.0, 10.0]
    theta = rng.normal(0, 0.3, 23)
    rate, d = hawkes.harmonic_rate(theta, grid)
    assert (rate > 0).all()
    for i in range(23):
        step = np.zeros(23)
        step[i] = 1e-6
        assert (hawkes.harmonic_rate(theta + step, grid)[0] - hawkes.harmonic_rate(theta - step, grid)[0]) / 2e-6 == pytest.approx(d[:, i], abs=1e-5)


def test_day_design_is_the_seasonality(spark):
    x = spark.range(0, 200_000, 137)
    got = x.select(*features.seasonality(F.col("id")).values()).toPandas().to_numpy(float)
    assert np.abs(got - hawkes.day_design(np.arange(0, 200_000, 137.0))).max() < 1e-9


def test_seasonal_solver_finds_the_wave():
    """Events of a rate that swings with the day: the wave is found, and beats a constant rate; no step makes it better."""
    rng = np.random.default_rng(1)
    at, lasts = hawkes.exposure(0.0, 20 * 86_400)
    true = lambda s: 1e-3 * (1 + 0.8 * np.cos(2 * np.pi * s / 86_400))
    s = rng.uniform(0, 20 * 86_400, 60_000)
    s = s[rng.uniform(0, 2e-3, len(s)) < true(s)]
    grid, own = hawkes.day_design(at), hawkes.day_design(s)
    w = 20 * 86_400 * 1e-3 / len(s)
    theta, value, done = hawkes.seasonal_solve(own, np.zeros(len(s)), w, grid, lasts, 1e-3)
    assert done and value > w * len(s) * np.log(1e-3) - 20 * 86.4 * 1 + 100
    fitted = hawkes.harmonic_rate(theta, grid)[0]
    assert np.corrcoef(fitted, true(at))[0, 1] > 0.95
    for _ in range(40):
        new = theta + rng.normal(0, 1e-4, 23)
        r = hawkes.harmonic_rate(new, own)[0]
        assert w * np.log(r).sum() - lasts @ hawkes.harmonic_rate(new, grid)[0] <= value + 0.5


def test_seasonal_profile_is_no_worse_than_constant(spark):
    _, e = events(spark, 400, 5, 30)
    e = e.where("event_code <> 7")
    fits = hawkes.fit(e, 400)
    got = hawkes.seasonal_profile(e, fits, most=400).collect()
    assert sorted(r["target"] for r in got) == list(range(10))
    for r in got:
        assert r["loglik"] >= r["constant"] - 0.05 and len(r["harmonic"]) == 16 and len(r["funding"]) == 6
    mu = {r["target"]: r["mu"] for r in hawkes.profiled(e, fits, 400).collect()}
    assert len(mu) == 10 and mu[7] == hawkes.FLOOR


def test_sample_has_the_states_of_the_whole(spark):
    _, e = events(spark, 300, 3)
    whole = {(r["event_time"], r["event_code"]): [r[decay.name_of(j, b)] for j in decay.CODES for b in (0.05, 0.5)] for r in decay.before_events(e, (0.05, 0.5)).collect()}
    got = hawkes.sample_states(e, 100, (0.05, 0.5)).collect()
    assert 50 < len(got) <= 100
    for r in got:
        assert r["x"] == pytest.approx(whole[r["event_time"], r["target"]])


def test_trees(spark):
    rng = np.random.default_rng(0)
    n = 3000
    a, b, c = rng.random(n), rng.random(n), rng.random(n)
    y = (((a > 0.6) ^ (b > 0.5)) | (rng.random(n) < 0.05)).astype(int)
    rows = [("S", t, float(u), None if t % 7 == 0 else float(v), float("nan") if t % 5 == 0 else float(w), int(k)) for t, (u, v, w, k) in enumerate(zip(a, b, c, y, strict=True))]
    x = spark.createDataFrame(rows, "symbol string, t long, a double, b double, c double, y int").persist()
    fits = [trees.Fit("all", ["a", "b", "c"], "y", None, 60), trees.Fit("early", ["b", "a"], "y", F.col("t") < 2000, 150, {"least": 20, "fraction": 1.0}), trees.Fit("none", ["a"], "y", F.col("t") < 0), trees.Fit("lam", ["a"], "y", None, 150, {"least": 20, "fraction": 1.0}, (["b"], {"S": ([0.5], [[2.0]])}))]
    made = trees.fit_all(x, fits, ["symbol", "t"])
    assert set(made) == {"all", "early", "lam"}
    p = trees.score_all(x, made, ["symbol", "t", "y"], {"early": F.col("t") >= 2000}).toPandas()
    assert p["early"].isna().sum() == 2000 and p["all"].between(0, 1).all()
    right = lambda q: ((p[q] > 0.5) == p["y"])[p[q].notna()].mean()
    assert right("all") > 0.85 and right("early") > 0.75 and right("lam") > 0.75
    again = trees.fit_all(x.repartition(7), fits, ["symbol", "t"])
    assert again["all"][1] == made["all"][1]
    with pytest.raises(ValueError):
        trees.tuned(x, fits[:1], "t", ["symbol", "t"], share=1.5)
    tuned = trees.tuned(x, [trees.Fit("own", ["a", "b"], "y", None, 10)], "t", ["symbol", "t"], 4)
    assert tuned["own"][2] >= tuned["own"][3] > 0


def test_trees_against_brute_force():
    """A tree of two leaves takes the cut of the largest gain, and its leaves the regularised means."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.integers(0, 6, (60, 3)).astype(float)
        x[rng.random(x.shape) < 0.1] = np.nan
        y = rng.integers(0, 2, 60)
        m = trees.Boosting(x, y, 1, 2, 5, 1.0, 1.0, rate=1.0)
        w = np.where(y == 1, (60 - y.sum()) / y.sum(), 1.0)
        g, h = w * (0.5 - y), w * 0.25
        gain = lambda on: sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (on, ~on))
        cuts = [np.where(np.isnan(x[:, i]), gone, x[:, i] <= v) for i in range(3) for v in range(6) for gone in (False, True)]
        best = max(gain(on) for on in cuts if 5 <= on.sum() <= 55)
        f, cut, gone = m.nodes[0][:3]
        on = np.where(np.isnan(x[:, f]), gone, x[:, f] <= cut)
        assert gain(on) == pytest.approx(best)
        value = np.where(on, -g[on].sum() / (h[on].sum() + 1), -g[~on].sum() / (h[~on].sum() + 1))
        assert trees.Scorer(m.model())(x) == pytest.approx(1 / (1 + np.exp(-value)))


@pytest.mark.parametrize("rare", [False, True])
def test_cut_between_present_and_missing(rare):
    """All present values can go low and the missing ones high, also if the largest is too rare for a cut of its own."""
    rng = np.random.default_rng(0)
    gone = np.arange(3000) < 600
    v = np.where(np.arange(3000) % 100 == 99, 9.0, rng.integers(0, 9, 3000)) if rare else rng.random(3000)
    y = (rng.random(3000) < np.where(gone, 0.9, 0.2)).astype(int)
    m = trees.Boosting(np.where(gone, np.nan, v)[:, None], y, 1, 2, 200, 1.0, 1.0)
    assert m.nodes[0][:3] == (0, np.inf, False)
    p = trees.Scorer(m.model())(np.where(gone, np.nan, v)[:, None])
    assert len(set(p[gone])) == len(set(p[~gone])) == 1 and p[0] > 0.5 > p[-1]


def test_ranks_of_tied_scores(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice([0.5, 0.5, 0.5, 0.1, 0.9, rng.random()]), rng.randrange(2)) for i in range(3000)]
    x = spark.createDataFrame(rows, "id int, g string, p double, y int")
    got = {(r["g"], r["id"]): (r["rank"], r["ones"]) for r in metrics.ranked(x, "p", ["id"], ["g"], F.col("y")).collect()}
    for g in "ab":
        ones = 0
        for place, (i, _, _, y) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            ones += y
            assert got[g, i] == (place, ones)


def test_registered_studies_are_whole(monkeypatch):
    """No fewer folds, budgets, rounds, labels or candidates than the studies have."""
    import inspect

    calls = {}
    monkeypatch.setattr(queries, "book_trades", lambda *a: (None, None))
    for name in ("learning_curve", "walk_forward", "label_grid", "marks_tested"):
        own = inspect.signature(getattr(experiments, name))

        def call(*a, own=own, **b):
            bound = own.bind(*a, **b)
            bound.apply_defaults()
            calls[key] = bound.arguments

        monkeypatch.setattr(experiments, name, call)
    for key in ("exp1_learning_curve", "exp2_walk_forward", "exp5_label_grid", "exp5_rolling_label_grid", "exp6_budget_sweep", "exp6_tuned_budgets", "exp6_static_variants", "exp6_rolling_variants"):
        queries.QUERIES[key](None, SF)
    assert calls["exp2_walk_forward"]["rounds"] == 120 and calls["exp2_walk_forward"]["models"] == ("m0", "m1", "m2", "m3")
    for key in ("exp1_learning_curve", "exp6_budget_sweep", "exp6_tuned_budgets", "exp6_static_variants"):
        assert len(calls[key]["budgets"]) == 7 and calls[key]["rounds"] == 160
    assert calls["exp6_tuned_budgets"]["tune"] == 16
    assert len(experiments.label_names(calls["exp5_label_grid"]["horizons"], calls["exp5_label_grid"]["depletions"])) == 12


def test_matrix_is_made_in_parts(spark, monkeypatch):
    """The plan that writes a matrix with marks and regime makes neither features, radii nor sizes of trades again, which
    Python makes of groups. With all of them in one plan the driver took more than its memory."""
    plans, own = [], files.write_features
    monkeypatch.setattr(files, "write_features", lambda x, *a: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or own(x, *a))
    x, _ = experiments.matrix(feeds.derived_book(spark, SF), feeds.derived_trades(spark, SF), extra=True)
    assert len(plans) == 1 and "FlatMapGroupsIn" not in plans[0]
    assert set(experiments.M0 + experiments.COUNTS + experiments.MARKS + ["regime", "day", "target_a_h10"]) < set(x.columns)


def test_walk_forward_keeps_folds(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.01"
    b, t = feeds.derived_book(spark, sf), feeds.derived_trades(spark, sf)
    first = experiments.walk_forward(b, t, 27, rounds=2, most=100, models=("m0", "m2"), path=f"{tmp_path}/f")
    assert first.columns == ["symbol", "tick", "day", "y", "m0", "m2"]
    rows = sorted(map(tuple, first.collect()))
    days = {r[2] for r in rows}
    assert rows and all(0 < r[4] < 1 and 0 < r[5] < 1 for r in rows)
    monkeypatch.setattr(trees, "fit_all", lambda *a: pytest.fail("a fold was made again"))
    assert sorted(map(tuple, experiments.walk_forward(b, t, 27, rounds=2, most=100, models=("m0", "m2"), path=f"{tmp_path}/f").collect())) == rows
    assert len(days) >= 1


def test_feature_sink(spark, tmp_path):
    x = spark.createDataFrame([("S", "d", 1, 0.1, 1)], "symbol string, day string, tick long, v double, a_h10 int")
    got = files.write_features(x, f"{tmp_path}/m", ["a_h10"])
    assert dict(got.dtypes) == {"symbol": "string", "day": "string", "tick": "bigint", "v": "float", "target_a_h10": "int"}
    assert [tuple(r) for r in got.select("symbol", "day", "tick", F.round("v", 6), "target_a_h10").collect()] == [("S", "d", 1, pytest.approx(0.1), 1)]
    assert files.write_features(x.limit(0), f"{tmp_path}/e", ["a_h10"]).count() == 0


def test_studies_of_nothing(spark):
    b, t = book(spark, (1, 10.0, 5.0, 11.0, 5.0)), trades(spark, (1, 10.0, 1.0, True))
    assert experiments.walk_forward(b, t, 3, rounds=2).count() == 0
    assert experiments.learning_curve(b, t, (10,), rounds=2).count() == experiments.label_grid(b, t, rounds=2).count() == 0


@pytest.fixture(scope="module")
def one_label(spark):
    """Feeds of which every sample of a_h10 is 1: a quote every five ticks, each at another price than the one before."""
    quotes = [(5 * i, 10.0 + i % 2, 5.0 + i % 3, 11.0 + i % 2, 5.0) for i in range(4 * 288)]
    return book(spark, *quotes), trades(spark, *((t, 11.0, 1.0, False) for t in range(7, 4 * 1440, 100)))


def test_one_label_is_not_fitted(spark, one_label, monkeypatch):
    """No model learns from windows of one label, so a budget sweep fits nothing to them; of other models' states m2 needs none."""
    x, _ = experiments.matrix(*one_label)
    assert {r[0] for r in x.select("target_a_h10").distinct().collect()} == {1}
    monkeypatch.setattr(experiments, "window_fits", lambda events, windows, most: pytest.fail("a fit that no model uses") if windows else {})
    monkeypatch.setattr(experiments, "with_marks_and_regime", lambda *a, **b: pytest.fail("states that no model uses"))
    got = experiments.learning_curve(*one_label, (120, 1440), test=1440, rounds=2, most=None, models=("m2",))
    assert got.count() == 0 and got.columns == ["model", "budget", "n", "prevalence", "brier", "log_loss", "pr_auc"]


def test_walk_forward_of_one_label(spark, one_label, tmp_path):
    """No day has a forecast: an empty table, also where an earlier run left its folder without a day."""
    path = f"{tmp_path}/f"
    for _ in range(2):
        got = experiments.walk_forward(*one_label, 2, rounds=2, most=100, models=("m0", "m2"), path=path)
        assert got.count() == 0 and got.columns == ["symbol", "tick", "day", "y", "m0", "m2"]
        spark.createDataFrame([], "symbol string").write.mode("overwrite").parquet(path)
    assert files.has_parts(spark, path, "forecast_day") is False


def test_marks_of_one_label(one_label):
    """Without forecasts the tests have no blocks and no p-value."""
    got = experiments.marks_tested(*one_label, 2).collect()
    assert [(r["model"], r["blocks"]) for r in got] == [("m3", 0), ("m3r", 0)]
    assert all(math.isnan(r[c]) for r in got for c in ("mean", "statistic", "p_value"))


def test_fits_are_dealt_out(spark, monkeypatch):
    """Jobs of a few windows each give the fits of one job but for rounding, and no window is left out."""
    x = spark.createDataFrame([(s, c) for s, n in (("a", 30), ("b", 5), ("c", 5), ("d", 50)) for c in (0, 1) for _ in range(n)], "symbol string, event_code int")
    assert experiments.dealt(x, 200, 20) == [["a"], ["b", "c"], ["d"]] and experiments.dealt(x, 100, 40) == [["a", "b", "c"], ["d"]]
    events, windows = align.aligned(feeds.derived_book(spark, SF), feeds.derived_trades(spark, SF)), {"1": (0, 10**9), "2": (28_410_000, 10**9)}
    whole = experiments.window_fits(events, windows, 100)
    own, fits = experiments.dealt, []
    monkeypatch.setattr(experiments, "dealt", lambda x, most: fits.append(own(x, most, 1)) or fits[-1])
    got = experiments.window_fits(events, windows, 100)
    assert len(fits[0]) == sum(map(len, whole.values())) > 1 and {w: set(f) for w, f in got.items()} == {w: set(f) for w, f in whole.items()}
    for w, g in ((w, g) for w in whole for g in whole[w]):  # rows come in another order, to which fits of few events are sensitive
        assert np.allclose(got[w][g][0], whole[w][g][0], atol=0.05) and np.allclose(got[w][g][1], whole[w][g][1], atol=0.05)


def test_walk_forward_fits_all_events(spark):
    """The registered study's fits are those of all events of a window, also of more than 10,000 of a type."""
    rng = np.random.default_rng(5)
    time, code = np.sort(rng.choice(12_000 * align.UNIT, 24_000, False)), np.where(rng.uniform(size=24_000) < 0.9, 0, 9)
    most = inspect.signature(experiments.walk_forward).parameters["most"].default
    rows = [("S", int(t), int(t) // align.UNIT, int(c)) for t, c in zip(time, code, strict=True)]
    e = spark.createDataFrame(rows, "symbol string, event_time long, tick long, event_code int").repartition(3)
    rates, t = np.asarray(decay.BETAS), time / align.UNIT
    z, x = np.zeros((10, len(rates))), np.empty((len(t), 50))
    for i, j in enumerate(code):
        z *= np.exp(-rates * (t[i] - t[i - 1])) if i else 1.0
        x[i] = z.ravel()
        z[j] += 1
    c = np.zeros((10, len(rates)))
    np.add.at(c, code, (1 - np.exp(-rates * (t[-1] - t)[:, None])) / rates)
    got = experiments.window_fits(e, {"w": (0, 10**9)}, most)["w"]["S"]
    for i in (0, 9):
        mu, alpha, _, _ = hawkes.solve(x[code == i], 1.0, c.ravel(), t[-1] - t[0])
        assert got[0][i] == pytest.approx(mu, rel=1e-3) and got[1][i] == pytest.approx(alpha, abs=1e-4)
    assert max(got[0][1:9]) < 1e-6
    fit = {r["target"]: r for r in hawkes.fit_whole(e).collect()}
    assert [fit[i]["n"] for i in range(10)] == np.bincount(code, minlength=10).tolist()


def test_states_and_fits_in_parts(spark, monkeypatch):
    """States that a task makes are those of the windows, however few it makes at a time, and parts give the fit of the whole."""
    _, e = events(spark, 400, 5, 30)
    rows = decay.before_events(e).orderBy("event_time").collect()
    at, code = np.array([r["event_time"] for r in rows]) / align.UNIT, np.array([r["event_code"] for r in rows])
    want = np.array([[r[decay.name_of(j, b)] for j in decay.CODES for b in decay.BETAS] for r in rows])
    at, rates = np.concatenate([at, at + 20_000]), np.asarray(decay.BETAS)  # a gap so long that what is before weighs nothing
    for slab in (7, 10**6):
        monkeypatch.setattr(hawkes, "SLAB", slab)
        for i in range(10):
            parts = list(hawkes.states_before(at, np.tile(code, 2), i, rates))
            got, n = np.vstack(parts), (code == i).sum()
            assert len(got) == 2 * n and (slab > 7 or max(map(len, parts)) <= 7) and np.allclose(got[:n], want[code == i])
            assert np.allclose(got[n:], want[code == i])
            whole, own = hawkes.solve(got, 1.0, np.ones(50), 100.0), hawkes.solve(lambda parts=parts: parts, 1.0, np.ones(50), 100.0)
            assert own[2] == pytest.approx(whole[2], rel=1e-6) and own[0] == pytest.approx(whole[0], abs=1e-3)
            assert sum(map(len, hawkes.joined(iter(parts)))) == len(got)


def test_walk_forward_draws_no_sample(spark, tmp_path, monkeypatch):
    """Neither the Hawkes fits nor the trees of a fold draw from its rows."""
    seen, own = [], trees.fit_all
    monkeypatch.setattr(hawkes, "drawn", lambda *a: pytest.fail("a sample"))
    monkeypatch.setattr(trees, "fit_all", lambda df, fits, order, most=trees.MOST: seen.append(most) or own(df, fits, order, most))
    sf = "/root/testdata/sf0.01"
    got = experiments.walk_forward(feeds.derived_book(spark, sf), feeds.derived_trades(spark, sf), 28, rounds=1, models=("m0", "m2"), path=f"{tmp_path}/f")
    assert got.count() > 0 and seen == [None]


def test_windows_that_teach(spark):
    x = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 1)], "tick long, a int, b int")
    windows = {"one": (0, 2), "both": (1, 3), "null": (3, 4), "none": (9, 12), "all": (0, 9)}
    assert list(experiments.taught(x, windows, ["a"])) == ["both", "all"]
    assert list(experiments.taught(x, {**windows, "null": (1, 4)}, ["a"])) == ["both", "null", "all"]
    assert list(experiments.taught(x, windows, ["b"])) == ["all"] and experiments.taught(x, {}, ["a"]) == {}


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.items(spark, date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError):
        files.items(spark, date(2024, 1, 1), date(2024, 1, 1), ("other",))
    x = spark.createDataFrame([("S", "2024-01-01", 1), ("S", "2024-01-03", 2)], "symbol string, day string, v int")
    files.write_days(x, f"{tmp_path}/d", rows=2)
    with pytest.raises(FileNotFoundError):
        files.read_days(spark, f"{tmp_path}/d", "2024-01-01", "2024-01-03")
    files.write_days(x.where("v = 2").withColumn("v", F.lit(5)), f"{tmp_path}/d", rows=1)
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [1, 5]
    with pytest.raises(ValueError):
        files.fold_once(spark, f"{tmp_path}/f", lambda: x, ["absent"])
    t = spark.createDataFrame([(1, 2.0, 3.0, 6.0, 9, True)], feeds.TRADES)
    t.coalesce(1).write.option("header", True).csv(f"{tmp_path}/c")
    assert files.convert_once(spark, f"{tmp_path}/c", f"{tmp_path}/p", feeds.TRADES) and not files.convert_once(spark, f"{tmp_path}/c", f"{tmp_path}/p", feeds.TRADES)
    assert spark.read.parquet(f"{tmp_path}/p").collect() == t.collect()
    files.convert_once(spark, f"{tmp_path}/c", f"{tmp_path}/q", feeds.TRADES, discard=True)
    assert not files.exists(spark, f"{tmp_path}/c") and spark.read.parquet(f"{tmp_path}/q").count() == 1
    with pytest.raises(RuntimeError):
        files.write_days(x, f"{tmp_path}/d", rows=3)
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/z.zip", "w") as z:
        z.writestr("z.csv", "id,price,qty,quote_qty,time,is_buyer_maker\n1,2.0,3.0,6.0,9,True\n")
    assert files.read_zip(spark, f"{tmp_path}/z.zip", feeds.TRADES).collect() == t.collect()
    assert "| S |" in files.report(x, f"{tmp_path}/r")


def test_filters_reach_the_files(spark, tmp_path):
    e = queries.events(spark, SF)
    e.write.parquet(f"{tmp_path}/e")
    plan = files.time_range(spark.read.parquet(f"{tmp_path}/e"), 1, 2).select("event_code")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_time,1)" in plan and "ReadSchema: struct<event_time:bigint,event_code" in plan


def test_streams(spark, tmp_path):
    _, e = events(spark, 50)
    for i in range(3):
        e.where(F.col("event_time") % 3 == i).select("symbol", "event_time", "event_code").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    x = stream.states(spark, f"{tmp_path}/in/*", f"{tmp_path}/s", 0.1).first()
    at = spark.createDataFrame([("S", x["event_time"])], "symbol string, event_time long")
    rows = e.collect()
    want = sum(math.exp(-0.1 * (x["event_time"] - r["event_time"]) / align.UNIT) for r in rows if r["event_code"] == 2)
    assert at.count() == 1 and x[decay.name_of(2, 0.1)] == pytest.approx(want)
    assert stream.windowed(spark, f"{tmp_path}/in/*", 10, "1 hour").isStreaming


def test_step_function_skips_nulls(spark):
    s = spark.createDataFrame([("S", 0, 1.0), ("S", 10, None), ("S", 20, 2.0)], "symbol string, tick long, value double")
    at = spark.createDataFrame([("S", -1), ("S", 15), ("S", 20)], "symbol string, tick long")
    assert [r["value"] for r in experiments.step_function(at, s).orderBy("tick").collect()] == [None, 1.0, 2.0]
