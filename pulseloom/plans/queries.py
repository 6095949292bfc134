"""Registered queries over the test tables, one or more per operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, audits, causality, decay, features, hawkes, labels, marks, metrics, trees
from ..sources import feeds, files
from ..streaming import stream
from . import experiments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


BASE = """WITH base AS (SELECT event_id, event_type, user_id, epoch_us(ts) // 60000000 AS tick, (event_id // 11) % 3 AS k, 'S' || ((user_id // 2) % 2) AS symbol FROM events),
trades AS (SELECT symbol, event_id AS id, tick, user_id % 2 = 1 AS is_buyer_maker, (100.0 + 0.5 * k - CASE WHEN user_id % 2 = 1 THEN 0.5 ELSE 0 END)::DOUBLE AS price, (1.0 + event_id % 5)::DOUBLE AS qty FROM base WHERE event_type = 'purchase'),
book AS (SELECT symbol, event_id AS update_id, tick, (99.5 + 0.5 * k)::DOUBLE AS bid_price, (5.0 + event_id * 7 % 13)::DOUBLE AS bid_qty, (100.0 + 0.5 * k)::DOUBLE AS ask_price, (5.0 + event_id * 5 % 11)::DOUBLE AS ask_qty FROM base WHERE event_type <> 'purchase')"""
QUOTES = BASE + """,
q AS (SELECT *, lag(bid_price) OVER w AS pbp, lag(bid_qty) OVER w AS pbq, lag(ask_price) OVER w AS pap, lag(ask_qty) OVER w AS paq, row_number() OVER w AS rn FROM book WINDOW w AS (PARTITION BY symbol ORDER BY tick, update_id))"""


def matched(rule: str) -> str:
    sign = ">=" if rule == "trades_first" else ">"
    return QUOTES + f""",
fq AS (SELECT symbol, tick AS qt, min(update_id) AS update_id FROM book GROUP BY ALL),
tm AS (SELECT t.*, fq.update_id FROM trades t LEFT JOIN (SELECT t.id, min(fq.qt) AS qt FROM trades t JOIN fq ON t.symbol = fq.symbol AND fq.qt {sign} t.tick GROUP BY t.id) n USING (id) LEFT JOIN fq ON fq.symbol = t.symbol AND fq.qt = n.qt)"""


def attributed(rule: str) -> str:
    return matched(rule) + """,
vol AS (SELECT tm.symbol, tm.update_id, sum(CASE WHEN price = pbp THEN qty END) AS bv, sum(CASE WHEN price = pap THEN qty END) AS av FROM tm JOIN q ON q.update_id = tm.update_id WHERE q.rn > 1 GROUP BY ALL),
a AS (SELECT q.*, coalesce(bv, 0)::DOUBLE AS bv, coalesce(av, 0)::DOUBLE AS av, bid_qty - pbq AS bd, ask_qty - paq AS ad FROM q LEFT JOIN vol USING (symbol, update_id) WHERE rn > 1)"""


def stream_of(rule: str) -> str:
    feed = ("1", "0") if rule == "trades_first" else ("0", "1")
    return attributed(rule) + f""",
qe AS (SELECT symbol, tick, update_id AS source_id, 0 AS side, bid_price AS price, CASE WHEN bid_price > pbp THEN 2 WHEN bid_price < pbp THEN 3 WHEN bd > 1e-12 THEN 0 WHEN bd < -1e-12 AND greatest(0, -bd - bv) > 1e-12 THEN 1 END AS event_code,
 CASE WHEN bid_price <> pbp THEN bid_qty WHEN bd > 1e-12 THEN bd ELSE greatest(0, -bd - bv) END AS volume FROM a
 UNION ALL SELECT symbol, tick, update_id, 1, ask_price, CASE WHEN ask_price > pap THEN 6 WHEN ask_price < pap THEN 7 WHEN ad > 1e-12 THEN 4 WHEN ad < -1e-12 AND greatest(0, -ad - av) > 1e-12 THEN 5 END,
 CASE WHEN ask_price <> pap THEN ask_qty WHEN ad > 1e-12 THEN ad ELSE greatest(0, -ad - av) END FROM a),
allev AS (SELECT symbol, tick, source_id, side, price, event_code, volume, {feed[0]} AS feed, 'bookTicker' AS source FROM qe WHERE event_code IS NOT NULL
 UNION ALL SELECT symbol, tick, id, 0, price, CASE WHEN is_buyer_maker THEN 9 ELSE 8 END, qty, {feed[1]}, 'trades' FROM trades),
ev AS (SELECT symbol, tick * 10000 + row_number() OVER (PARTITION BY symbol, tick ORDER BY feed, source_id, side) - 1 AS event_time, tick, event_code,
 ['bid_qty_up', 'bid_qty_down', 'bid_price_up', 'bid_price_down', 'ask_qty_up', 'ask_qty_down', 'ask_price_up', 'ask_price_down', 'trade_buy', 'trade_sell'][event_code + 1] AS event_type, price, volume, source, source_id FROM allev)"""


EV, EVB = stream_of("trades_first"), stream_of("book_first")


def book_trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return feeds.derived_book(spark, sf_dir), feeds.derived_trades(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str, rule: str = "trades_first") -> DataFrame:
    return align.aligned(*book_trades(spark, sf_dir), rule)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned stream as a written table, for what reads it several times."""
    return files.staged(events(spark, sf_dir), "aligned")


# Sources and sinks


@query("SELECT 'S0' AS symbol, feed, strftime(day, '%Y-%m-%d') AS day FROM (SELECT unnest(['trades', 'bookTicker']) AS feed), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day)")
def src1_items(spark, sf_dir):
    from datetime import date

    return files.items(spark, date(2024, 1, 1), date(2024, 1, 30))


@query(BASE + " SELECT id, price, qty, price * qty AS quote_qty, tick AS time, is_buyer_maker FROM trades")
def src5_csv_to_parquet(spark, sf_dir):
    csv, out = files.shared_path(spark, "csv"), files.shared_path(spark, "parquet")
    t = feeds.derived_trades(spark, sf_dir).select("id", "price", "qty", (F.col("price") * F.col("qty")).alias("quote_qty"), F.col("tick").alias("time"), "is_buyer_maker")
    t.write.option("header", True).csv(csv)
    files.convert_once(spark, csv, out, feeds.TRADES)
    return spark.read.schema(feeds.TRADES).parquet(out)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND event_id >= 100")
def src8_projected_scan(spark, sf_dir):
    return feeds.table(spark, sf_dir, "events").where("event_type = 'click' AND event_id >= 100").select("event_id", "user_id", "value")


@query(BASE + " SELECT symbol, strftime(make_timestamp(tick * 60000000), '%Y-%m-%d') AS day, count(*) AS n, sum(qty) AS volume FROM trades WHERE tick >= 28401120 + 1440 * 4 AND tick < 28401120 + 1440 * 9 GROUP BY ALL")
def src9_day_range(spark, sf_dir):
    out = files.shared_path(spark, "days")
    t = feeds.derived_trades(spark, sf_dir).withColumn("day", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(tick div 1440 AS int)")), "yyyy-MM-dd"))
    files.write_days(t, out, rows=t.count())
    x = files.read_days(spark, out, "2024-01-05", "2024-01-09")
    return x.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("qty").alias("volume"))


@query(EV + " SELECT symbol, event_time, event_code FROM ev WHERE event_time >= 284100000000 AND event_time < 284200000000")
def src10_time_range(spark, sf_dir):
    return files.time_range(events(spark, sf_dir), 284_100_000_000, 284_200_000_000).select("symbol", "event_time", "event_code")


@query(EV + " SELECT symbol, event_time, event_code, volume FROM ev WHERE event_time >= 284100000000 AND event_time < 284200000000 AND event_code >= 8")
def src11_trade_range(spark, sf_dir):
    return files.time_range(events(spark, sf_dir), 284_100_000_000, 284_200_000_000, True).select("symbol", "event_time", "event_code", "volume")


@query(BASE + " SELECT symbol, count(*) AS n, sum(volume) AS volume FROM (SELECT symbol, tick // 1440 AS d, sum(qty) AS volume FROM trades GROUP BY ALL) GROUP BY ALL")
def snk3_json_results(spark, sf_dir):
    out = files.shared_path(spark, "json")
    t = feeds.derived_trades(spark, sf_dir).groupBy("symbol", F.expr("tick div 1440").alias("d")).agg(F.sum("qty").alias("volume"))
    files.write_json(t, out)
    return spark.read.schema("symbol string, d long, volume double").json(out).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query(BASE + " SELECT tick // 1440 AS day, count(*) AS n FROM trades GROUP BY ALL")
def snk5_fold_once(spark, sf_dir):
    path = files.shared_path(spark, "fold")
    make = lambda: feeds.derived_trades(spark, sf_dir).groupBy(F.expr("tick div 1440").alias("day")).agg(F.count("*").alias("n"))
    files.fold_once(spark, path, make, ["day", "n"])
    return files.fold_once(spark, path, make, ["day", "n"]).select("day", "n")


# Projection, typing, alignment


@query(BASE + " SELECT symbol, id, CASE WHEN is_buyer_maker THEN 9 ELSE 8 END AS event_code FROM trades")
def prj4_trade_direction(spark, sf_dir):
    return align.directions(feeds.derived_trades(spark, sf_dir)).select("symbol", "id", "event_code")


@query(QUOTES + " SELECT symbol, update_id, bid_qty - pbq AS bid_change, ask_qty - paq AS ask_change FROM q WHERE rn > 1")
def win1_previous_quote(spark, sf_dir):
    q = align.transitions(feeds.derived_book(spark, sf_dir)).where("prev IS NOT NULL")
    return q.select("symbol", "update_id", (F.col("bid_qty") - F.col("prev.bid_qty")).alias("bid_change"), (F.col("ask_qty") - F.col("prev.ask_qty")).alias("ask_change"))


KINDS = f"(SELECT unnest(range(10))::INT AS event_code, unnest({list(feeds.EVENT_TYPES)}) AS event_type)"


@query(EV + f" SELECT symbol, k.event_code, k.event_type, count(ev.tick) AS n FROM (SELECT DISTINCT symbol FROM ev) CROSS JOIN {KINDS} k LEFT JOIN ev USING (symbol, event_code) GROUP BY ALL")
def agg2_event_counts(spark, sf_dir):
    return align.event_counts(events(spark, sf_dir))


@query(EV + f" SELECT symbol, k.event_code, k.event_type, count(ev.tick) AS n FROM (SELECT DISTINCT symbol FROM ev WHERE event_code >= 8) CROSS JOIN {KINDS} k LEFT JOIN (SELECT * FROM ev WHERE event_code >= 8) ev USING (symbol, event_code) GROUP BY ALL")
def agg2_counts_of_trades_alone(spark, sf_dir):
    return align.event_counts(events(spark, sf_dir).where("event_code >= 8"))


@query(EV + " SELECT symbol, tick, source_id, event_code, price, volume FROM ev WHERE source = 'bookTicker'")
def win2_quote_events(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return align.quote_events(align.attributed(align.transitions(b), t)).select("symbol", "tick", "source_id", "event_code", "price", "volume")


@query(EV + " SELECT * FROM ev")
def win3_aligned_trades_first(spark, sf_dir):
    return events(spark, sf_dir)


@query(EVB + " SELECT * FROM ev")
def win3_aligned_book_first(spark, sf_dir):
    return events(spark, sf_dir, "book_first")


@query(matched("trades_first") + " SELECT symbol, id, update_id FROM tm")
def jn4_next_quote_inclusive(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return align.matched_quotes(align.transitions(b), t).select("symbol", "id", F.col("match.update_id").alias("update_id"))


@query(matched("book_first") + " SELECT symbol, id, update_id FROM tm")
def jn5_next_quote_exclusive(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return align.matched_quotes(align.transitions(b), t, "book_first").select("symbol", "id", F.col("match.update_id").alias("update_id"))


@query(attributed("trades_first") + " SELECT symbol, update_id, bv AS bid_traded, av AS ask_traded FROM a WHERE bv > 0 OR av > 0")
def agg1_attributed_volume(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return align.attributed(align.transitions(b), t).where("bid_traded > 0 OR ask_traded > 0").select("symbol", "update_id", "bid_traded", "ask_traded")


@query(EV + """ , s AS (SELECT symbol, count(*) AS transitions, (count(*) FILTER (pbp = bid_price AND bd < -1e-12 AND greatest(0, -bd - bv) <= 1e-12) + count(*) FILTER (pap = ask_price AND ad < -1e-12 AND greatest(0, -ad - av) <= 1e-12)) AS explained FROM a GROUP BY symbol)
 SELECT symbol, transitions, explained, 0::BIGINT AS unclassified, """ + ", ".join(f"count(*) FILTER (event_code = {i}) AS {n}" for i, n in enumerate(feeds.EVENT_TYPES)) + " FROM ev JOIN s USING (symbol) GROUP BY ALL")
def agg3_alignment_stats(spark, sf_dir):
    return align.alignment_stats(*book_trades(spark, sf_dir))


# Samples


GRID = QUOTES + """,
b AS (SELECT symbol, (min(tick) + 9) // 10 * 10 AS a, (max(tick) - {lead}) // 10 * 10 AS z, min(tick) AS first FROM book GROUP BY symbol),
g AS (SELECT symbol, first, unnest(range(a, z + 1, 10)) AS tick FROM b),
lq AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol, tick ORDER BY update_id DESC) = 1)"""


def grid(lead: int) -> str:
    return GRID.replace("{lead}", str(lead))


@query(grid(11) + " SELECT symbol, tick FROM g")
def dat2_sample_grid(spark, sf_dir):
    return features.grid(feeds.derived_book(spark, sf_dir))


ASOF = " SELECT g.symbol, g.tick, lq.update_id, lq.tick AS quote_tick FROM g ASOF LEFT JOIN lq ON g.symbol = lq.symbol AND g.tick + {d} >= lq.tick"


@query(grid(11) + ASOF.replace("{d}", "0"))
def jn1_as_of(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    return features.as_of(features.grid(b), b).select("symbol", "tick", "quote.update_id", F.col("quote.tick").alias("quote_tick"))


@query(grid(11) + " SELECT symbol, tick, update_id FROM (" + ASOF.replace("{d}", "0") + ") WHERE tick - quote_tick <= 5")
def jn2_as_of_tolerance(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    return features.as_of(features.grid(b), b).where("tick - quote.tick <= 5").select("symbol", "tick", "quote.update_id")


@query(grid(11) + ASOF.replace("{d}", "3"))
def jn3_as_of_offset(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    return features.as_of(features.grid(b), b, "quote", 3).select("symbol", "tick", "quote.update_id", F.col("quote.tick").alias("quote_tick"))


@query(EV + """, e AS (SELECT symbol, tick // 60 * 60 AS edge, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT DISTINCT symbol, tick FROM trades)
 SELECT t.symbol, t.tick, e.n FROM t ASOF LEFT JOIN e ON t.symbol = e.symbol AND t.tick >= e.edge""")
def jn8_regime_as_of(spark, sf_dir):
    regime = events(spark, sf_dir).groupBy("symbol", F.expr("tick div 60 * 60").alias("tick")).agg(F.count("*").alias("value"))
    at = feeds.derived_trades(spark, sf_dir).select("symbol", "tick").distinct()
    return experiments.step_function(at, regime).select("symbol", "tick", F.col("value").alias("n"))


L1 = grid(3) + """,
s0 AS (SELECT g.symbol, g.first, g.tick, lq.tick AS qt, lq.bid_price AS bp, lq.bid_qty AS bq, lq.ask_price AS ap, lq.ask_qty AS aq FROM g ASOF LEFT JOIN lq ON g.symbol = lq.symbol AND g.tick >= lq.tick),
s1 AS (SELECT s0.*, lq.tick AS lt FROM s0 ASOF LEFT JOIN lq ON s0.symbol = lq.symbol AND s0.tick + 3 >= lq.tick),
s2 AS (SELECT *, lag(bp) OVER w AS lbp, lag(bq) OVER w AS lbq, lag(ap) OVER w AS lap, lag(aq) OVER w AS laq, tick - qt <= 100 AS active FROM s1 WINDOW w AS (PARTITION BY symbol ORDER BY tick)),
s3 AS (SELECT x.symbol, x.tick, count(*) FILTER (y.active) AS n, count(*) FILTER (y.active AND y.bq <= x.bq) AS nb, count(*) FILTER (y.active AND y.aq <= x.aq) AS na FROM s2 x JOIN s2 y ON x.symbol = y.symbol AND y.tick BETWEEN x.tick - 720 AND x.tick GROUP BY ALL)"""


@query(L1 + f""" SELECT symbol, tick, {s6("CASE WHEN lbp IS NULL THEN 0 ELSE CASE WHEN bp >= lbp THEN bq ELSE 0 END - CASE WHEN bp <= lbp THEN lbq ELSE 0 END - CASE WHEN ap <= lap THEN aq ELSE 0 END + CASE WHEN ap >= lap THEN laq ELSE 0 END END")} AS ofi,
 {s6("(ap * bq + bp * aq) / greatest(bq + aq, 1e-12) - (ap + bp) / 2")} AS micro_minus_mid, ap - bp AS spread, bq AS bid_qty, aq AS ask_qty, {s6("nb / n")} AS bid_qty_rank, {s6("na / n")} AS ask_qty_rank
 FROM s2 JOIN s3 USING (symbol, tick) WHERE active AND tick + 3 - lt <= 100 AND tick >= first + 720 AND n >= 60""")
def flt2_l1_features(spark, sf_dir):
    x = features.l1_features(feeds.derived_book(spark, sf_dir))
    return x.select("symbol", "tick", r6("ofi").alias("ofi"), r6("micro_minus_mid").alias("micro_minus_mid"), "spread", "bid_qty", "ask_qty", r6("bid_qty_rank").alias("bid_qty_rank"), r6("ask_qty_rank").alias("ask_qty_rank"))


@query(L1 + f""" SELECT symbol, tick, {s6("CASE WHEN lbp IS NULL THEN 0 ELSE CASE WHEN bp >= lbp THEN bq ELSE 0 END - CASE WHEN bp <= lbp THEN lbq ELSE 0 END - CASE WHEN ap <= lap THEN aq ELSE 0 END + CASE WHEN ap >= lap THEN laq ELSE 0 END END")} AS ofi FROM s2""")
def win4_order_flow(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    return features.order_flow(features.as_of(features.grid(b, lead=3), b)).select("symbol", "tick", r6("ofi").alias("ofi"))


@query(L1 + f" SELECT symbol, tick, CASE WHEN active THEN {s6('nb / n')} ELSE 1.0 END AS bid_rank, n AS active_count FROM s2 JOIN s3 USING (symbol, tick)")
def win6_rolling_rank(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    s = features.as_of(features.grid(b, lead=3), b).select("symbol", "tick", F.col("quote.bid_qty").alias("bid"), F.coalesce(F.col("tick") - F.col("quote.tick") <= 100, F.lit(False)).alias("active"))
    return features.rolling_rank(s, ["bid"], "active").select("symbol", "tick", r6("bid_rank").alias("bid_rank"), "active_count")


@query(BASE + f" SELECT symbol, update_id, ask_price - bid_price AS spread, {s6('(ask_price * bid_qty + bid_price * ask_qty) / (bid_qty + ask_qty) - (ask_price + bid_price) / 2')} AS micro_minus_mid FROM book")
def mth1_micro_price(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir).withColumn("quote", F.struct("bid_price", "bid_qty", "ask_price", "ask_qty"))
    m = features.micro_price()
    return b.select("symbol", "update_id", m["spread"].alias("spread"), r6(m["micro_minus_mid"]).alias("micro_minus_mid"))


def label_sql() -> str:
    w = lambda h, e: f"(SELECT {e} FROM q WHERE q.symbol = s.symbol AND q.tick BETWEEN s.tick + 1 AND s.tick + 1 + {h})"
    cols = []
    for h in (2, 10, 40):
        cols.append(f"coalesce({w(h, 'max((q.bid_price < s.bp OR q.ask_price > s.ap)::INT)')}, 0) AS a_h{h}")
        for x in (0.25, 0.5):
            pure = w(h, "min((q.bid_price = s.bp AND q.ask_price = s.ap)::INT)")
            low = w(h, f"max((q.bid_qty < s.bq * (1 - {x}::DOUBLE) OR q.ask_qty < s.aq * (1 - {x}::DOUBLE))::INT)")
            cols.append(f"coalesce(least({pure}, {low}), 0) AS b_x{round(100 * x)}_h{h}")
    return grid(41) + ", s AS (SELECT g.symbol, g.tick, bid_price AS bp, bid_qty AS bq, ask_price AS ap, ask_qty AS aq FROM g ASOF LEFT JOIN lq ON g.symbol = lq.symbol AND g.tick >= lq.tick) SELECT s.symbol, s.tick, " + ", ".join(cols) + " FROM s"


@query(label_sql())
def win5_labels(spark, sf_dir):
    b = feeds.derived_book(spark, sf_dir)
    return labels.labels(features.as_of(features.grid(b, lead=41), b), b, [2, 10, 40], [0.25, 0.5])


# Decayed states


def state_sql(prefix: str, rows: str, time: str, cond: str, weight: str = "1.0", mark: bool = False, codes=range(10), betas=decay.BETAS, keys=("symbol", "tick")) -> str:
    cols = [f"{s6(f'coalesce(sum({weight} * exp(-{b} * (r.{time} - e.event_time) / 10000)) FILTER (e.event_code = {c}), 0)')} AS {decay.name_of(c, b, mark)}" for b in betas for c in codes]
    key = ", ".join(f"r.{k}" for k in keys)
    return prefix + f" SELECT {key}, {', '.join(cols)} FROM {rows} r LEFT JOIN e ON r.symbol = e.symbol AND {cond} GROUP BY {key}"


def rounded(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.select(*keys, *(r6(c).alias(c) for c in x.columns if c.startswith("z_")))


SAMPLES = EV + ", e AS (SELECT * FROM ev), g AS (SELECT symbol, unnest(range(a, z + 1, 10)) AS tick FROM (SELECT symbol, (min(tick) + 9) // 10 * 10 AS a, (max(tick) - 11) // 10 * 10 AS z FROM book GROUP BY symbol)), gt AS (SELECT symbol, tick, tick * 10000 AS t FROM g)"


@query(state_sql(SAMPLES, "gt", "t", "e.event_time <= r.t AND e.event_time > r.t - 50000 * 10000"))
def win9_decayed_states(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return rounded(decay.sampled(align.aligned(b, t), features.grid(b)), ["symbol", "tick"])


@query(state_sql(SAMPLES, "gt", "t", "e.event_time <= r.t AND e.event_time > r.t - 50000 * 10000", "e.volume", True, (8, 9)))
def win10_weighted_states(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return rounded(decay.sampled(align.aligned(b, t), features.grid(b), codes=(8, 9), weight="volume"), ["symbol", "tick"])


SOME = (0.01, 0.25)
BEFORE = EV + ", e AS (SELECT * FROM ev)"


@query(state_sql(BEFORE, "ev", "event_time", "e.event_time < r.event_time AND e.event_time > r.event_time - 10000 * 10000", betas=SOME, keys=("symbol", "event_time")))
def win11_states_before_events(spark, sf_dir):
    return rounded(decay.before_events(events(spark, sf_dir), SOME), ["symbol", "event_time"])


@query(state_sql(BEFORE, "ev", "event_time", "e.event_time < r.event_time AND e.event_time > r.event_time - 10000 * 10000", "e.volume", True, (8, 9), SOME, ("symbol", "event_time")))
def win12_weighted_before_events(spark, sf_dir):
    return rounded(decay.before_events(events(spark, sf_dir), SOME, (8, 9), "volume"), ["symbol", "event_time"])


def masked_sql() -> str:
    cols = [f"{s6(f'coalesce(sum(exp(-{b} * (r.tick - e.tick))) FILTER (e.event_code = {c} AND NOT (r.crossing AND e.tick = r.tick AND ((r.event_code >= 8 AND e.event_code IN (2, 3, 6, 7)) OR (r.event_code IN (2, 3, 6, 7) AND e.event_code >= 8)))), 0)')} AS {decay.name_of(c, b)}" for b in SOME for c in range(10)]
    return EV + f", m AS (SELECT *, max((event_code >= 8)::INT) OVER w = 1 AND max((event_code IN (2, 3, 6, 7))::INT) OVER w = 1 AS crossing FROM ev WINDOW w AS (PARTITION BY symbol, tick)) SELECT r.symbol, r.event_time, {', '.join(cols)} FROM m r LEFT JOIN ev e ON r.symbol = e.symbol AND e.event_time < r.event_time AND e.tick > r.tick - 10000 GROUP BY r.symbol, r.event_time"


@query(masked_sql())
def win13_masked_states(spark, sf_dir):
    return rounded(decay.before_events_masked(events(spark, sf_dir), feeds.TOUCH, SOME), ["symbol", "event_time"])


MEDIAN = BASE + ", m AS (SELECT x.symbol, x.id, x.qty, median(y.qty) AS median FROM trades x LEFT JOIN trades y ON x.symbol = y.symbol AND y.tick >= x.tick - 720 AND (y.tick < x.tick OR (y.tick = x.tick AND y.id < x.id)) GROUP BY ALL)"


@query(MEDIAN + " SELECT symbol, id, median FROM m")
def win7_rolling_median(spark, sf_dir):
    t = feeds.derived_trades(spark, sf_dir).withColumn("seq", F.col("id"))
    return marks.rolling_median_before(t, "qty").select("symbol", "id", "median")


@query(MEDIAN + f" SELECT symbol, id, {s6('CASE WHEN median > 0 THEN qty / median ELSE 1.0 END')} AS mark FROM m")
def win8_trade_size_marks(spark, sf_dir):
    return marks.trade_size_marks(feeds.derived_trades(spark, sf_dir)).select("symbol", "id", r6("mark").alias("mark"))


def season_sql() -> str:
    s = "(tick * 60 % 86400)"
    cols = [f"{s6(f'{f}(2 * pi() * {k} * {s} / 86400)')} AS {f}_{k}" for k in range(1, 9) for f in ("cos", "sin")]
    for h in (0, 8, 16):
        d = f"((({s} - {h * 3600} + 43200) % 86400 + 86400) % 86400 - 43200)"
        cols += [f"({d} >= -300 AND {d} < 0)::INT::DOUBLE AS before_{h:02d}", f"({d} >= 0 AND {d} <= 300)::INT::DOUBLE AS after_{h:02d}"]
    return grid(11) + f" SELECT symbol, tick, {', '.join(cols)} FROM g"


@query(season_sql())
def mth5_seasonality(spark, sf_dir):
    g = features.grid(feeds.derived_book(spark, sf_dir))
    d = features.seasonality(F.col("tick") * 60)
    return g.select("symbol", "tick", *((r6(v) if k[:3] in ("cos", "sin") else v).alias(k) for k, v in d.items()))


@query(grid(11) + f" SELECT symbol, tick, {s6('greatest((1e-9 + exp(-1.0) + sqrt(0.25 + 1e-9) + 7 * sqrt(1e-9) + 0.3 * cos(2 * pi() * (tick * 60 % 86400) / 86400) + 0.4 * sin(2 * pi() * (tick * 60 % 86400) / 86400)) * exp(CASE WHEN (tick * 60 % 86400) <= 300 THEN 0.7 ELSE 0 END), 1e-9)')} AS rate FROM g")
def mth7_seasonal_rate(spark, sf_dir):
    g = features.grid(feeds.derived_book(spark, sf_dir))
    rate = features.seasonal_rate(features.seasonality(F.col("tick") * 60), -1.0, [0.3, 0.4] + [0.0] * 14, [0.0, 0.7, 0.0, 0.0, 0.0, 0.0])
    return g.select("symbol", "tick", r6(rate).alias("rate"))


@query("SELECT symbol, event_time, " + ", ".join(f"{s6(f'greatest(0.1 + {0.01 * (i + 1)} * z_event{i}_beta0p01 + 0.02 * z_event{9 - i}_beta0p25, 1e-12)')} AS hawkes_lambda_{i}" for i in range(10)) + " FROM (" + state_sql(BEFORE, "ev", "event_time", "e.event_time < r.event_time AND e.event_time > r.event_time - 10000 * 10000", betas=SOME, keys=("symbol", "event_time")).replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")") + ")")
def mth8_intensity(spark, sf_dir):
    states = decay.before_events(events(spark, sf_dir), SOME)
    alpha = [[0.0] * 20 for _ in range(10)]
    for i in range(10):
        alpha[i][2 * i] += 0.01 * (i + 1)
        alpha[i][2 * (9 - i) + 1] += 0.02
    lam = hawkes.intensity(states, [0.1] * 10, alpha, SOME)
    return states.select("symbol", "event_time", *(r6(v).alias(k) for k, v in lam.items()))


# Metrics and tests


FC = "WITH f AS (SELECT event_id, epoch_us(ts) // 60000000 AS tick, (event_type = 'purchase')::INT AS y, (event_id * 7919 % 1000) / 1000 AS p, (event_id * 104729 % 997) / 997 AS p2 FROM events), l AS (SELECT *, -(y * ln(least(1 - 1e-12, greatest(1e-12, p))) + (1 - y) * ln(1 - least(1 - 1e-12, greatest(1e-12, p)))) AS la, -(y * ln(least(1 - 1e-12, greatest(1e-12, p2))) + (1 - y) * ln(1 - least(1 - 1e-12, greatest(1e-12, p2)))) AS lb FROM f)"


def forecasts(spark, sf_dir) -> DataFrame:
    e = feeds._ticks(spark, sf_dir)
    x = e.select("event_id", "tick", (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("event_id") * 7919 % 1000 / 1000).alias("p"), (F.col("event_id") * 104729 % 997 / 997).alias("p2"))
    return x.withColumn("la", metrics.log_loss(F.col("y"), F.col("p"))).withColumn("lb", metrics.log_loss(F.col("y"), F.col("p2")))


@query(FC + f" SELECT count(*) AS n, {s6('avg(y)')} AS prevalence, {s6('avg((y - p) * (y - p))')} AS brier, {s6('avg(la)')} AS log_loss FROM l")
def agg5_brier_log_loss(spark, sf_dir):
    return forecasts(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("prevalence"), r6(metrics.brier(F.col("y"), F.col("p"))).alias("brier"), r6(F.avg("la")).alias("log_loss"))


@query(FC + f", r AS (SELECT y, row_number() OVER w AS r, sum(y) OVER w AS c FROM f WINDOW w AS (ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING)) SELECT count(*) AS positives, {s6('avg(c / r)')} AS average_precision FROM r WHERE y = 1")
def win17_average_precision(spark, sf_dir):
    x = metrics.average_precision(forecasts(spark, sf_dir).select("event_id", "y", "p"), "y", "p", ["event_id"])
    return x.select("positives", r6("average_precision").alias("average_precision"))


@query(FC + f", t AS (SELECT quantile_cont(p, 0.99) AS t FROM f) SELECT {s6('max(t)')} AS threshold, {s6('avg((p >= t)::INT)')} AS alert_rate, {s6('count(*) FILTER (p >= t AND y = 1) / greatest(1, sum(y))')} AS recall, median(tick % 1440) FILTER (p >= t AND y = 1) AS median_lead FROM f, t")
def agg9_alert_metrics(spark, sf_dir):
    x = metrics.alert_metrics(forecasts(spark, sf_dir).withColumn("lead", F.col("tick") % 1440), "y", "p", "lead", ["event_id"])
    return x.select(r6("threshold").alias("threshold"), r6("alert_rate").alias("alert_rate"), r6("recall").alias("recall"), "median_lead")


@query(FC + f" SELECT tick // 60 AS block, {s6('avg(la - lb)')} AS diff FROM l GROUP BY ALL")
def agg4_block_means(spark, sf_dir):
    x = metrics.block_means(forecasts(spark, sf_dir), F.expr("tick div 60"), F.col("la"), F.col("lb"))
    return x.select("block", r6("diff").alias("diff"))


NW = FC + """, b AS (SELECT tick // 60 AS block, avg(la - lb) AS d FROM l GROUP BY ALL), c AS (SELECT row_number() OVER (ORDER BY block) AS i, d - avg(d) OVER () AS c, count(*) OVER () AS n, avg(d) OVER () AS m FROM b),
k AS (SELECT unnest(range(0, (SELECT least(max(n) - 1, floor(4 * (max(n) / 100) ** (2 / 9)))::BIGINT + 1 FROM c))) AS lag),
v AS (SELECT k.lag, sum(x.c * y.c) / max(x.n) AS cov, max(x.n) AS n, max(x.m) AS m FROM k JOIN c x ON true JOIN c y ON y.i = x.i + k.lag GROUP BY k.lag)"""


@query(NW + f" SELECT lag, {s6('cov')} AS cov FROM v")
def win18_autocovariances(spark, sf_dir):
    b = metrics.block_means(forecasts(spark, sf_dir), F.expr("tick div 60"), F.col("la"), F.col("lb"))
    cov = metrics.autocovariances(b)[2]
    return spark.createDataFrame(list(enumerate(cov)), "lag long, cov double").select("lag", r6("cov").alias("cov"))


@query(NW + f", s AS (SELECT max(n) AS n, max(m) AS m, sum(CASE WHEN lag = 0 THEN cov ELSE 2 * (1 - lag / (SELECT max(lag) + 1 FROM v)) * cov END) AS lr FROM v) SELECT n AS blocks, {s6('m')} AS mean, {s6('m / sqrt(lr / n)')} AS statistic FROM s")
def sta1_giacomini_white(spark, sf_dir):
    r = metrics.giacomini_white(forecasts(spark, sf_dir), F.expr("tick div 60"), F.col("la"), F.col("lb"))
    return spark.createDataFrame([(r["blocks"], r["mean"], r["statistic"])], "blocks long, mean double, statistic double").select("blocks", r6("mean").alias("mean"), r6("statistic").alias("statistic"))


@query(FC + f", d AS (SELECT tick // 1440 AS day, la - lb AS d1, (y - p) * (y - p) - (y - p2) * (y - p2) AS d2 FROM l), m AS (SELECT avg(d1) AS m1, avg(d2) AS m2 FROM d) SELECT day, count(*) AS n, {s6('sum(d1 - m1)')} AS d1_s, {s6('sum(d2 - m2)')} AS d2_s, {s6('sum((d1 - m1) * (d1 - m1))')} AS d1_ss, {s6('sum((d2 - m2) * (d2 - m2))')} AS d2_ss FROM d, m GROUP BY day")
def sta2_day_moments(spark, sf_dir):
    x = metrics.day_moments(differentials(spark, sf_dir), "day", ["d1", "d2"])
    return x.select("day", "n", *(r6(c).alias(c) for c in ("d1_s", "d2_s", "d1_ss", "d2_ss")))


def differentials(spark, sf_dir) -> DataFrame:
    sq = lambda p: F.pow(F.col("y") - F.col(p), 2)
    return forecasts(spark, sf_dir).select(F.expr("tick div 1440").alias("day"), (F.col("la") - F.col("lb")).alias("d1"), (sq("p") - sq("p2")).alias("d2"))


@query()
def sta2_romano_wolf(spark, sf_dir):
    return spark.createDataFrame(list(metrics.romano_wolf(differentials(spark, sf_dir), "day", ["d1", "d2"]).items()), "hypothesis string, p_value double")


# Audits


@query(BASE + f", d AS (SELECT *, (tick + CASE WHEN update_id % 50 = 0 THEN 1440 ELSE 0 END) // 1440 AS day FROM book) SELECT symbol, day, count(*) AS n, count(*) FILTER (tick // 1440 = day) AS inside, count(DISTINCT tick // 10) FILTER (tick // 1440 = day) AS active, {s6('count(DISTINCT tick // 10) FILTER (tick // 1440 = day) * 1000.0 / 1440')} AS percent FROM d GROUP BY ALL")
def agg12_coverage(spark, sf_dir):
    filed = F.expr("floor((tick + CASE WHEN update_id % 50 = 0 THEN 1440 ELSE 0 END) / 1440)")
    x = audits.coverage(feeds.derived_book(spark, sf_dir).withColumn("day", filed))
    return x.withColumn("percent", r6("percent"))


@query(BASE + ", x AS (SELECT DISTINCT symbol, tick // 1440 AS day, tick % 1440 // 10 AS s FROM book), y AS (SELECT * FROM x UNION ALL SELECT symbol, day, unnest([-1, 144]) FROM (SELECT DISTINCT symbol, day FROM x)), z AS (SELECT symbol, day, s - lag(s) OVER (PARTITION BY symbol, day ORDER BY s) - 1 AS g FROM y) SELECT symbol, day, count(*) FILTER (g > 0) AS n_gaps, coalesce(max(g), 0) AS longest FROM z GROUP BY ALL")
def agg17_gaps(spark, sf_dir):
    return audits.gaps(feeds.derived_book(spark, sf_dir))


@query(BASE + ", x AS (SELECT symbol, tick, id, lag(tick) OVER w AS pt, lag(id) OVER w AS pi FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY id * 7919 % 10007, id)) SELECT symbol, count(*) FILTER (tick < pt) AS back, count(*) FILTER (tick = pt AND id < pi) AS ids FROM x GROUP BY symbol")
def agg14_order_violations(spark, sf_dir):
    path = files.shared_path(spark, "unsorted")
    t = feeds.derived_trades(spark, sf_dir).withColumn("feed", F.col("symbol")).repartition("symbol").sortWithinPartitions("feed", F.col("id") * 7919 % 10007, "id")
    t.write.partitionBy("feed").parquet(path)
    return audits.order_violations(files.in_file_order(spark, path)).select("symbol", "back", "ids")


@query(BASE + f", x AS (SELECT symbol, tick - lag(tick) OVER (PARTITION BY symbol ORDER BY tick, update_id) AS g FROM book) SELECT symbol, count(g) AS n, {s6('avg((g < 10)::INT)')} AS near FROM x WHERE g IS NOT NULL GROUP BY symbol")
def agg13_spacing(spark, sf_dir):
    return audits.spacing(feeds.derived_book(spark, sf_dir)).withColumn("near", r6("near"))


@query(BASE + f", x AS (SELECT symbol, tick - lag(tick) OVER (PARTITION BY symbol ORDER BY tick, update_id) AS g FROM book), n AS (SELECT symbol, count(g) AS n, avg((g < 2)::INT) AS near FROM x WHERE g IS NOT NULL GROUP BY symbol), b AS (SELECT DISTINCT symbol, tick FROM book), t AS (SELECT DISTINCT symbol, tick, 1 AS x FROM trades), c AS (SELECT symbol, count(x) / count(*) AS share FROM b LEFT JOIN t USING (symbol, tick) GROUP BY symbol) SELECT symbol, n, {s6('near')} AS near, {s6('share')} AS share, CASE WHEN near > 0 THEN {s6('share / near')} END AS normalised FROM n JOIN c USING (symbol)")
def agg13_crowding(spark, sf_dir):
    return audits.crowding(*book_trades(spark, sf_dir), near=2).select("symbol", "n", *(r6(c).alias(c) for c in ("near", "share", "normalised")))


@query(BASE + f", b AS (SELECT DISTINCT symbol, tick FROM book), t AS (SELECT DISTINCT symbol, tick, 1 AS x FROM trades) SELECT symbol, count(*) AS book_ticks, count(x) AS shared, {s6('count(x) / count(*)')} AS share FROM b LEFT JOIN t USING (symbol, tick) GROUP BY symbol")
def jn10_shared_ticks(spark, sf_dir):
    return audits.shared_ticks(*book_trades(spark, sf_dir)).withColumn("share", r6("share"))


DAILY = BASE + ", s AS (SELECT *, tick // 1440 AS day, ln(price) - ln(lag(price) OVER (PARTITION BY symbol, tick // 1440 ORDER BY tick, id)) AS r FROM trades), d AS (SELECT symbol, day, count(*) AS n, sum(qty) AS volume, sum(qty * price) AS turnover, sqrt(coalesce(sum(r * r), 0)) AS volatility FROM s GROUP BY ALL)"


@query(DAILY + f" SELECT symbol, day, n, volume, turnover, {s6('volatility')} AS volatility FROM d")
def agg6_daily_summary(spark, sf_dir):
    return audits.daily_summary(feeds.derived_trades(spark, sf_dir)).withColumn("volatility", r6("volatility"))


@query(DAILY + f", m AS (SELECT symbol, median(volume) AS m FROM d WHERE day < 19744 GROUP BY symbol), a AS (SELECT symbol, m, median(abs(volume - m)) AS mad FROM d JOIN m USING (symbol) WHERE day < 19744 GROUP BY ALL) SELECT symbol, day, {s6('CASE WHEN mad > 0 THEN (volume - m) / (1.4826 * mad) END')} AS z, coalesce(abs(CASE WHEN mad > 0 THEN (volume - m) / (1.4826 * mad) END) > 3.5, false) AS flag FROM d JOIN a USING (symbol)")
def agg7_robust_z(spark, sf_dir):
    x = audits.robust_z(audits.daily_summary(feeds.derived_trades(spark, sf_dir)), "volume", "day < 19744")
    return x.select("symbol", "day", r6("z").alias("z"), "flag")


@query(EV + ", w AS (SELECT symbol, tick // 60 * 60 AS start, count(*) AS n FROM ev GROUP BY ALL) SELECT symbol, start, n FROM w WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM (VALUES (28402000, 28403000), (28410000, 28410500)) g(a, b) WHERE start < b AND a < start + 60)")
def flt4_without_gaps(spark, sf_dir):
    known = spark.createDataFrame([(28_402_000, 28_403_000), (28_410_000, 28_410_500)], "gap_start long, gap_end long")
    w = events(spark, sf_dir).groupBy("symbol", F.expr("tick div 60 * 60").alias("start")).agg(F.count("*").alias("n")).where("n >= 5").withColumn("end", F.col("start") + 60)
    return audits.without_gaps(w, known).select("symbol", "start", "n")


@query(FC + ", m AS (SELECT max(tick) - 1440 * 5 AS b FROM f) SELECT count(*) AS n, min(tick) AS first, max(tick) AS last FROM f, m WHERE tick >= b - 1440 * 3 AND tick < b")
def flt3_train_window(spark, sf_dir):
    x = forecasts(spark, sf_dir)
    return experiments.train_window(x, "tick", 1440 * 5, 1440 * 3).agg(F.count("*").alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last"))


@query(BASE + " SELECT tick FROM book INTERSECT SELECT tick FROM trades")
def set3_common_ticks(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return b.select("tick").intersect(t.select("tick"))


@query(BASE + " SELECT symbol, tick, update_id AS id, 'book' AS feed FROM book UNION ALL SELECT symbol, tick, id, 'trades' FROM trades")
def set2_feed_union(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    return b.select("symbol", "tick", F.col("update_id").alias("id"), F.lit("book").alias("feed")).unionByName(t.select("symbol", "tick", "id", F.lit("trades").alias("feed")))


# Order sensitivity


MIXED = EV + ", m AS (SELECT symbol, tick, count(*) AS n, count(*) FILTER (event_code >= 8) AS t, count(*) FILTER (event_code IN (2, 3, 6, 7)) AS c FROM ev GROUP BY ALL)"


@query(MIXED + f" SELECT symbol, count(*) FILTER (t > 0 AND c > 0) AS groups, coalesce(sum(n) FILTER (t > 0 AND c > 0), 0)::BIGINT AS rows, coalesce(sum(t) FILTER (t > 0 AND c > 0), 0)::BIGINT AS trades, coalesce(sum(c) FILTER (t > 0 AND c > 0), 0)::BIGINT AS touches, {s6('coalesce(sum(n) FILTER (t > 0 AND c > 0), 0) / sum(n)')} AS share FROM m GROUP BY symbol")
def agg15_collisions(spark, sf_dir):
    return causality.collisions(events(spark, sf_dir)).withColumn("share", r6("share"))


@query(MIXED + " SELECT symbol, event_time, t > 0 AND c > 0 AS crossing FROM ev JOIN m USING (symbol, tick)")
def win15_crossing_mask(spark, sf_dir):
    return causality.crossing_mask(events(spark, sf_dir)).select("symbol", "event_time", "crossing")


@query(EV + ", x AS (SELECT symbol, tick, event_time, event_code, row_number() OVER (PARTITION BY symbol, tick ORDER BY event_time) AS s, row_number() OVER (PARTITION BY symbol, tick ORDER BY event_code >= 8, event_time) AS p FROM ev) SELECT a.symbol, a.tick, a.event_time, b.event_code FROM x a JOIN x b ON a.symbol = b.symbol AND a.tick = b.tick AND a.s = b.p")
def win14_quotes_first(spark, sf_dir):
    return causality.quotes_first(events(spark, sf_dir))


MATRIX = "WITH x AS (SELECT i // 10 AS target, i % 10 AS source, (i * 37 % 101) / 101 AS value, (i * 53 % 97) / 97 AS after FROM range(100) t(i)), d AS (SELECT *, after - value AS d, CASE WHEN source >= 8 THEN 'trade' ELSE 'quote' END || '_to_' || CASE WHEN target >= 8 THEN 'trade' ELSE 'quote' END AS block FROM x)"


def matrices(spark) -> tuple[DataFrame, DataFrame]:
    i = spark.range(100).select("id", F.expr("cast(id div 10 AS int)").alias("target"), (F.col("id") % 10).cast("int").alias("source"))
    return i.select("target", "source", (F.col("id") * 37 % 101 / 101).alias("value")), i.select("target", "source", (F.col("id") * 53 % 97 / 97).alias("value"))


@query(MATRIX + f", b AS (SELECT block, sqrt(sum(value * value)) AS base, sqrt(sum(d * d)) AS change, max(abs(d)) AS largest FROM d GROUP BY block) SELECT block, {s6('base')} AS base, {s6('change')} AS change, {s6('change / base')} AS relative, {s6('change * change / sum(change * change) OVER ()')} AS share, {s6('largest')} AS largest FROM b")
def agg16_gamma_change(spark, sf_dir):
    x = causality.gamma_change(*matrices(spark))
    return x.select("block", *(r6(c).alias(c) for c in ("base", "change", "relative", "share", "largest")))


@query(MATRIX + f" SELECT target::INT AS target, source::INT AS source, block, {s6('d')} AS d FROM d ORDER BY abs(d) DESC, target, source LIMIT 15")
def top1_gamma_terms(spark, sf_dir):
    return causality.top_changes(*matrices(spark)).select("target", "source", "block", r6("d").alias("d"))


# Models


def compensator_sql(weight: str = "") -> str:
    cols = [f"SELECT symbol, event_code AS source, {p} AS scale, {s6(f'sum({weight}(1 - exp(-{b} * (t - event_time) / 10000)) / {b})')} AS c FROM x GROUP BY ALL" for p, b in enumerate(decay.BETAS)]
    return EV + ", x AS (SELECT *, max(event_time) OVER (PARTITION BY symbol) AS t FROM ev) " + " UNION ALL ".join(cols)


@query(compensator_sql())
def agg10_compensators(spark, sf_dir):
    return hawkes.compensators(events(spark, sf_dir)).select("symbol", "source", "scale", r6("c").alias("c"))


@query("SELECT symbol, source, scale, round(c, 3) + 0.0::DOUBLE AS c FROM (" + compensator_sql("volume * ").replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")") + ")")
def agg10_marked_compensators(spark, sf_dir):
    x = hawkes.compensators(events(spark, sf_dir), weight="volume")  # in the millions, so to three places
    return x.select("symbol", "source", "scale", (F.round("c", 3) + F.lit(0.0)).alias("c"))


@query(EV + " SELECT symbol, event_code, count(*) AS stratum, least(count(*), 200) AS n FROM ev GROUP BY ALL")
def smp1_stratified(spark, sf_dir):
    return hawkes.stratified(events(spark, sf_dir), 2000).groupBy("symbol", "event_code", "stratum").agg(F.count("*").alias("n"))


@query(EV + ", w AS (SELECT symbol, tick // 1440 * 1440 AS start, count(*) AS n FROM ev GROUP BY ALL) SELECT symbol, start, n FROM w WHERE n >= 100 AND start < (SELECT max(start) FROM w v WHERE v.symbol = w.symbol)")
def win16_windows(spark, sf_dir):
    return hawkes.windowed_radius(events(spark, sf_dir), 1440).select("symbol", "start", "n")


@query()
def mdl1_hawkes_fit(spark, sf_dir):
    return hawkes.fit(stored(spark, sf_dir))


def weights() -> list[list[float]]:
    """Some alpha for SOME: of each target, itself at the slow scale and its mirror at the fast one."""
    alpha = [[0.0] * 20 for _ in range(10)]
    for i in range(10):
        alpha[i][2 * i] += 0.001 * (i + 1)
        alpha[i][2 * (9 - i) + 1] += 0.02
    return alpha


def excited_sql() -> str:
    """Events with their excitation under weights()."""
    raw = state_sql("", "ev", "event_time", "e.event_time < r.event_time AND e.event_time > r.event_time - 10000 * 10000", betas=SOME, keys=("symbol", "event_time", "event_code")).replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")")
    own = " ".join(f"WHEN {i} THEN {0.001 * (i + 1)} * z_event{i}_beta0p01 + 0.02 * z_event{9 - i}_beta0p25" for i in range(10))
    return BEFORE + f", z AS ({raw}), x AS (SELECT symbol, event_time, event_code, CASE event_code {own} END AS exc FROM z), s AS (SELECT symbol, min(event_time) AS a, max(event_time) AS t FROM ev GROUP BY symbol), k AS (SELECT s.*, unnest(range(10))::INT AS target FROM s)"


COMPENSATED = " + ".join(f"coalesce(sum({w} * (1 - exp(-{b} * (t - event_time) / 10000)) / {b}) FILTER (ev.event_code = {c}), 0)" for b, w, c in ((0.01, "0.001 * (target + 1)", "target"), (0.25, "0.02", "9 - target")))


@query(excited_sql() + f", l AS (SELECT symbol, event_code AS target, sum(ln(0.05 + exc)) AS logs FROM x GROUP BY ALL), c AS (SELECT symbol, target, {COMPENSATED} AS c FROM k JOIN ev USING (symbol) GROUP BY ALL) SELECT symbol, target, round(coalesce(logs, 0) - 0.05 * (t - a) / 10000 - c, 4) + 0.0::DOUBLE AS loglik FROM k JOIN c USING (symbol, target) LEFT JOIN l USING (symbol, target)")
def mdl1_loglikelihood(spark, sf_dir):
    x = hawkes.loglikelihood(stored(spark, sf_dir), [0.05] * 10, weights(), SOME)
    return x.select("symbol", "target", (F.round("loglik", 4) + F.lit(0.0)).alias("loglik"))


def rate_sql(s: str) -> str:
    d = f"((({s} + 43200) % 86400) - 43200)"
    return f"greatest((1e-9 + exp(-3.0) + sqrt(0.0025 + 1e-9) + 7 * sqrt(1e-9) + 0.03 * cos(2 * pi() * {s} / 86400) + 0.04 * sin(2 * pi() * {s} / 86400)) * exp(CASE WHEN {d} >= 0 AND {d} <= 300 THEN 0.7 ELSE 0 END), 1e-9)"


@query(excited_sql() + f", l AS (SELECT symbol, event_code AS target, sum(ln(greatest(1e-12, greatest(exc, 1e-12) + {rate_sql('(event_time / 10000 * 60 % 86400)')}))) AS logs FROM x GROUP BY ALL), g AS (SELECT symbol, a, (t - a) / 10000 * 60 AS n, unnest(range(0, greatest(1, ceil((t - a) / 10000))::BIGINT)) AS i FROM s), b AS (SELECT symbol, sum({rate_sql('((a / 10000 * 60 + 60 * i + 30) % 86400)')} * least(60, n - 60 * i) / 60) AS base FROM g GROUP BY symbol) SELECT symbol, target, round(coalesce(logs, 0) - base, 4) + 0.0::DOUBLE AS loglik FROM k JOIN b USING (symbol) LEFT JOIN l USING (symbol, target)")
def mdl5_loglikelihood(spark, sf_dir):
    rate = lambda s: features.seasonal_rate(features.seasonality(s), -3.0, [0.03, 0.04] + [0.0] * 14, [0.0, 0.7, 0.0, 0.0, 0.0, 0.0])
    x = hawkes.seasonal_loglikelihood(stored(spark, sf_dir), rate, weights(), SOME)
    return x.select("symbol", "target", (F.round("loglik", 4) + F.lit(0.0)).alias("loglik"))


@query("SELECT 'S' AS symbol, t.i::INT AS target, s.i::INT AS source, " + s6(" + ".join(f"((t.i * 50 + s.i * 5 + {p}) * 37 % 101) / 1000 / {b}" for p, b in enumerate(decay.BETAS))) + " AS value FROM range(10) t(i), range(10) s(i)")
def mdl2_gamma_of_weights(spark, sf_dir):
    k = F.sequence(F.col("id") * 50, F.col("id") * 50 + 49)
    fits = spark.range(10).select(F.lit("S").alias("symbol"), F.col("id").cast("int").alias("target"), F.transform(k, lambda i: i * 37 % 101 / 1000).alias("alpha"))
    return hawkes.gamma(fits).select("symbol", "target", "source", r6("value").alias("value"))


@query()
def mdl2_stationary_gamma(spark, sf_dir):
    return hawkes.gamma(hawkes.stationary(hawkes.fit(stored(spark, sf_dir))))


@query()
def mdl3_marked_fit(spark, sf_dir):
    return experiments.marked_fit(stored(spark, sf_dir), feeds.derived_trades(spark, sf_dir))


@query()
def mdl4_profiled_mu(spark, sf_dir):
    e = stored(spark, sf_dir)
    return hawkes.profiled(e, files.staged(hawkes.fit(e), "fits"))


@query()
def mdl5_seasonal_profile(spark, sf_dir):
    e = stored(spark, sf_dir)
    return hawkes.seasonal_profile(e, files.staged(hawkes.fit(e), "fits"))


@query()
def mdl6_windowed_radius(spark, sf_dir):
    return hawkes.windowed_radius(stored(spark, sf_dir), 1440)


def one_model(spark, sf_dir, make) -> DataFrame:
    """Probabilities of all samples by the model that make(matrix, fits) gives."""
    x, events = experiments.matrix(*book_trades(spark, sf_dir))
    made = make(x, experiments.ladder("all", "target_a_h10", None, None, 160, ("m1",)))
    p = trees.score_all(x, {"probability": m[:2] for m in made.values()}, ["symbol", "tick", "target_a_h10"])
    return p.withColumnRenamed("target_a_h10", "a_h10")


@query()
def mdl7_boosted_trees(spark, sf_dir):
    return one_model(spark, sf_dir, lambda x, fits: trees.fit_all(x, fits, ["symbol", "tick"]))


@query()
def mdl8_tuned_trees(spark, sf_dir):
    return one_model(spark, sf_dir, lambda x, fits: trees.tuned(x, fits, "tick", ["symbol", "tick"]))


@query()
def sta3_marks_and_regime(spark, sf_dir):
    b, t = book_trades(spark, sf_dir)
    x = experiments.with_marks_and_regime(features.grid(b, lead=3), b, t, events=stored(spark, sf_dir))
    return x.select("symbol", "tick", *experiments.MARKS, "regime")


@query(L1 + ", v AS (SELECT symbol, tick, bp, ap FROM s2 JOIN s3 USING (symbol, tick) WHERE active AND tick + 3 - lt <= 100 AND tick >= first + 720 AND n >= 60) SELECT v.symbol, v.tick, v.tick // 1440 AS day, coalesce(max((q.bid_price < v.bp OR q.ask_price > v.ap)::INT), 0) AS target_a_h10 FROM v LEFT JOIN q ON q.symbol = v.symbol AND q.tick BETWEEN v.tick + 1 AND v.tick + 11 GROUP BY ALL")
def snk2_feature_matrix(spark, sf_dir):
    """Rows, days and labels of the written feature matrix, which all studies learn from."""
    return experiments.matrix(*book_trades(spark, sf_dir))[0].select("symbol", "tick", "day", "target_a_h10")


BUDGETS = (120, *(1440 * days for days in (1, 3, 7, 14, 23, 31)))  # ticks of training; more than the table has is all of it


@query()
def exp1_learning_curve(spark, sf_dir):
    return experiments.learning_curve(*book_trades(spark, sf_dir), budgets=BUDGETS)


@query()
def exp2_walk_forward(spark, sf_dir):
    return experiments.walk_forward(*book_trades(spark, sf_dir), training_days=10)


@query()
def exp3_tie_sensitivity(spark, sf_dir):
    return experiments.tie_sensitivity(*book_trades(spark, sf_dir))


@query()
def exp4_order_only_gamma(spark, sf_dir):
    return experiments.order_only(*book_trades(spark, sf_dir))


@query()
def exp5_label_grid(spark, sf_dir):
    return experiments.label_grid(*book_trades(spark, sf_dir))


@query()
def exp5_rolling_label_grid(spark, sf_dir):
    return experiments.label_grid(*book_trades(spark, sf_dir), rounds=120, training_days=10)


@query()
def exp6_budget_sweep(spark, sf_dir):
    return experiments.learning_curve(*book_trades(spark, sf_dir), budgets=BUDGETS, most=None, models=("m2",))


@query()
def exp6_tuned_budgets(spark, sf_dir):
    return experiments.learning_curve(*book_trades(spark, sf_dir), budgets=BUDGETS, models=("m1", "m2"), tune=16)


@query()
def exp6_static_variants(spark, sf_dir):
    return experiments.learning_curve(*book_trades(spark, sf_dir), budgets=BUDGETS, models=("m1", "m3", "m3r", "m3k"))


@query()
def exp6_rolling_variants(spark, sf_dir):
    return experiments.marks_tested(*book_trades(spark, sf_dir), training_days=10)


@query()
def exp7_seasonal_gain(spark, sf_dir):
    return mdl5_seasonal_profile(spark, sf_dir).select("symbol", "target", (F.col("loglik") - F.col("constant")).alias("gain"))


@query()
def exp8_transfer(spark, sf_dir):
    return experiments.transfer(stored(spark, sf_dir), "S0")


# Streaming


@query(EV + " SELECT symbol, event_code, count(*) AS n FROM ev GROUP BY ALL")
def str1_streamed_counts(spark, sf_dir):
    path = files.shared_path(spark, "stream")
    events(spark, sf_dir).select("symbol", "event_time", "event_code").write.parquet(path)
    return stream.counts(spark, path, files.shared_path(spark, "stream-state"))


@query(state_sql(BEFORE, "ev", "event_time", "e.event_time <= r.event_time", betas=(0.05,), keys=("symbol", "event_time")).replace("FROM ev r", "FROM (SELECT symbol, max(event_time) AS event_time FROM ev GROUP BY symbol) r"))
def str2_streamed_states(spark, sf_dir):
    path = files.shared_path(spark, "stream")
    events(spark, sf_dir).select("symbol", "event_time", "event_code").write.parquet(path)
    return rounded(stream.states(spark, path, files.shared_path(spark, "stream-state"), 0.05), ["symbol", "event_time"])
