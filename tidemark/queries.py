"""Registered queries of the library and the SQL each is compared with.

Ticks are the events table (symbol = event_type, price = 100 + value); bars are hourly. Times come out as epoch
seconds and numbers rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import indicators as I
from .functions import text as T1
from .functions.columns import before, by_time, deviation, forward_fill, percentile_rank, quantile, rolling, safe_div, zscore
from .operators import asof as J
from .operators import scan
from .plans import features as FT
from .plans import ledger as B
from .plans import metrics as A
from .plans import research as R
from .plans import signals as SG
from .sources import events as EV
from .sources import market as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Times as epoch seconds, numbers to six places, counts as long."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        c = F.unix_timestamp(c) if kind.startswith("timestamp") else F.round(c, 6) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c
        out.append(c.alias(f.name))
    return df.select(*out)


def rsi_ledger(spark: SparkSession, sf_dir: str, long_only: bool = True) -> DataFrame:
    """Bars, RSI momentum (neutral exit) and the ledger at 6 basis points."""
    return B.ledger(SG.rsi_momentum(M.bars(spark, sf_dir)), B.cost_rate(5.0, 1.0), long_only=long_only)


RSI_LEDGER = f"{S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, sg AS (SELECT * EXCLUDE (turnover), {S.neutral()} AS signal FROM rs), {S.ledger('sg')}"
RSI_SHORT = f"{S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, sg AS (SELECT * EXCLUDE (turnover), {S.neutral()} AS signal FROM rs), {S.ledger('sg', low='-1')}"
MET = f"symbol, {S.r(*S.METRICS)}, max_consecutive_losing_days"


@query(f"WITH {RSI_LEDGER}, {S.metrics()} SELECT {MET} FROM metrics")
def metrics_rsi_momentum(spark, d):
    """The flagship."""
    return tidy(A.metrics(rsi_ledger(spark, d)))


# sources, sinks and rows
@query(f"WITH {S.BARS} SELECT symbol, ts, {S.r('open', 'high', 'low', 'close', 'volume', 'turnover')} FROM bars")
def bars_from_ticks(spark, d):
    """A2."""
    return tidy(M.bars(spark, d))


@query(f"WITH {S.BARS} SELECT symbol, CAST(floor(ts / 14400) AS BIGINT) * 14400 AS ts, {S.r('arg_min(open, ts) AS open', 'max(high) AS high', 'min(low) AS low', 'arg_max(close, ts) AS close', 'sum(volume) AS volume')} FROM bars GROUP BY 1, 2")
def bars_resampled(spark, d):
    """A1."""
    return tidy(M.resample(M.bars(spark, d), "4 hours"))


@query(
    """WITH b AS (SELECT o_orderpriority AS symbol, epoch(o_orderdate)::BIGINT AS ts, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS close, o_totalprice AS open, o_totalprice * (CASE WHEN o_orderkey % 31 = 0 THEN 0.9 ELSE 1.1 END) AS high, o_totalprice * 0.9 AS low, CASE WHEN o_orderkey % 53 = 0 THEN -1.0 ELSE 1.0 END AS volume FROM orders),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts) > 1 AS dup FROM b)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (close IS NULL) AS n_null_close, count(*) FILTER (volume < 0) AS n_negative_volume, count(*) FILTER (high < greatest(open, close, low)) AS n_high_too_low, count(*) FILTER (low > least(open, close, high)) AS n_low_too_high, count(*) FILTER (dup) AS n_duplicate_ts, count(*) FILTER (close IS NULL) AS n_null_close_values, count(*) - count(DISTINCT ts) AS n_extra_ts FROM f GROUP BY symbol"""
)
def validation_report(spark, d):
    """IO3, A10-A12 on orders as bars."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    df = o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), p.alias("open"), (p * F.when(k % 31 == 0, 0.9).otherwise(1.1)).alias("high"), (p * 0.9).alias("low"), F.when(k % 97 != 0, p).alias("close"), F.when(k % 53 == 0, -1.0).otherwise(1.0).alias("volume"))
    return tidy(M.rule_report(df))


@query(f"WITH {S.BARS} SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, min(ts) <= 1704153600 AND max(ts) >= 1706400000 AS covers FROM bars GROUP BY symbol")
def coverage_profile(spark, d):
    """IO7, IO12, A22."""
    return tidy(M.profile(M.bars(spark, d), "2024-01-02 00:00:00", "2024-01-28 00:00:00"))


_SQL = """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 1"""


@query(_SQL)
def sql_over_parquet(spark, d):
    """IO8."""
    return M.run_sql(M.utc(spark), _SQL, {t: f"{d}/{t}.parquet" for t in ("orders", "customer", "nation")})


_CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


@query(_CUBE)
def sql_grouping_sets(spark, d):
    """IO8: grouping sets."""
    return M.run_sql(M.utc(spark), _CUBE, {"lineitem": f"{d}/lineitem.parquet"})


_SETS = "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0"


@query(_SETS)
def sql_set_operations(spark, d):
    """IO8: intersect and except."""
    return M.run_sql(M.utc(spark), _SETS, {t: f"{d}/{t}.parquet" for t in ("customer", "supplier", "nation")})


def context_events(spark, d) -> DataFrame:
    """The events table as context: the type is the signal, user_id modulo 3 the symbol."""
    e = M.utc(spark).read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source"), F.col("event_type").alias("signal_type"), F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string")).alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"), "value", (F.col("event_id") % 5 != 0).alias("historical_integrity"), F.col("props").alias("metadata"))


CONTEXT = "ctx AS (SELECT 's' || (event_id % 2) AS source, event_type AS signal_type, 'U' || (user_id % 3) AS symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS ts, value, event_id % 5 <> 0 AS historical_integrity, props AS metadata, event_id FROM events)"


@query(f"WITH {CONTEXT} SELECT source, signal_type, symbol, ts, round(value, 6) AS value, historical_integrity FROM ctx WHERE symbol = 'U1' AND ts BETWEEN 1704412800 AND 1705017600")
def event_store_range(spark, d):
    """IO5, IO6: the store written, and read for one symbol and range."""
    from .sources.store import scratch

    path = scratch(spark, "events")
    M.write_events(context_events(spark, d), path)
    out = M.read_events(spark, path, "U1", "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return tidy(out.select("source", "signal_type", "symbol", "ts", "value", "historical_integrity"))


@query("SELECT o_orderstatus AS symbol, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS ts, round(o_totalprice, 6) AS bid, round(o_totalprice + o_custkey % 7, 6) AS ask FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice IS NOT NULL")
def detected_prices(spark, d):
    """IO10: a day and a time of day as text, a close and a spread."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    rows = o.select(F.col("o_orderstatus").alias("symbol"), F.date_format(at, "yyyyMMdd").alias("Date"), F.date_format(at, "HH:mm:ss").alias("Timestamp"), F.col("o_totalprice").alias("Close"), (F.col("o_custkey") % 7).alias("Spread"))
    return tidy(M.detect_prices(rows, year=1997))


@query("SELECT o_orderstatus AS symbol, epoch(o_orderdate)::BIGINT AS ts, round(o_totalprice - 1, 6) AS bid, round(o_totalprice + 2, 6) AS ask FROM orders WHERE o_custkey % 5 <> 0")
def detected_quotes(spark, d):
    """IO10: milliseconds of an Open_time that goes before ts, bids and asks, of which some are missing."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_orderstatus").alias("symbol"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("Open_time"), F.lit(0).alias("ts"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice") - 1).alias("BID"), (F.col("o_totalprice") + 2).alias("Ask"))
    return tidy(M.detect_prices(rows))


@query("SELECT o_orderstatus AS symbol, 1577836800 + (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS ts, round(o_totalprice, 6) AS bid, round(o_totalprice, 6) AS ask FROM orders")
def detected_closes(spark, d):
    """IO10: no time, so rows are numbered by their key; closes only."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    return tidy(M.detect_prices(o.select(F.col("o_orderstatus").alias("symbol"), "o_orderkey", F.col("o_totalprice").alias("close")), order="o_orderkey"))


@query(
    "WITH x AS (SELECT DISTINCT replace(replace(upper(trim(n_name)), ' ', '_'), '/', '-') AS raw FROM nation) SELECT raw, CASE WHEN len(string_split(replace(raw, '_', '-'), '-')) = 2 THEN replace(raw, '_', '-') || '-SWAP' ELSE replace(raw, '_', '-') END AS symbol FROM x"
)
def canonical_symbols(spark, d):
    """P3."""
    n = M.utc(spark).read.parquet(f"{d}/nation.parquet").select(F.translate(F.upper(F.trim("n_name")), " /", "_-").alias("raw")).distinct()
    return n.select("raw", M.normal_symbol(F.col("raw")).alias("symbol"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_seconds, CAST(floor(epoch(ts)) AS BIGINT) AS from_millis, CAST(floor(epoch(ts)) AS BIGINT) AS from_text FROM events")
def normal_times(spark, d):
    """Seconds, milliseconds and text."""
    e = M.utc(spark).read.parquet(f"{d}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    e = e.select("event_id", F.unix_timestamp("t").alias("s"), F.unix_millis("t").alias("m"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("x"))
    return tidy(e.select("event_id", M.normal_time(F.col("s"), "bigint").alias("from_seconds"), M.normal_time(F.col("m"), "bigint").alias("from_millis"), M.normal_time(F.col("x"), "string").alias("from_text")))


@query(
    f"""WITH {S.MARKET}, k AS (SELECT symbol, ts, low AS bb, high AS ba, volume AS bs, open AS a_s FROM market)
SELECT * FROM (SELECT 'funding' AS source, 'funding_rate' AS signal_type, symbol, ts, round(funding_rate, 6) AS value, TRUE AS historical_integrity FROM market
UNION ALL SELECT 'open_interest', 'open_interest', symbol, ts, round(open_interest, 6), TRUE FROM market
UNION ALL SELECT 'basis', 'basis_bps', symbol, ts, round((close - spot_close) / spot_close * 1e4, 6), TRUE FROM market
UNION ALL SELECT 'orderbook', 'spread_bps', symbol, ts, round((ba - bb) / ((ba + bb) / 2) * 1e4, 6), TRUE FROM k
UNION ALL SELECT 'orderbook', 'depth_imbalance', symbol, ts, round(coalesce((bs - a_s) / nullif(bs + a_s, 0), 0.0), 6), TRUE FROM k
UNION ALL SELECT 'liquidations', 'liquidation_imbalance', symbol, ts, round(coalesce((open - close) / nullif(open + close, 0), 0.0), 6), FALSE FROM market) WHERE value IS NOT NULL"""
)
def context_long_form(spark, d):
    """P5-P9, O4."""
    m = M.market(spark, d)
    book = m.select("symbol", "ts", F.col("low").alias("best_bid"), F.col("high").alias("best_ask"), F.col("volume").alias("bid_size"), F.col("open").alias("ask_size"))
    liq = m.select("symbol", "ts", F.col("open").alias("long_liquidation_notional"), F.col("close").alias("short_liquidation_notional"))
    basis = m.select("symbol", "ts", F.col("close").alias("perp_price"), F.col("spot_close").alias("spot_price"))
    parts = [EV.funding_events(m), EV.interest_events(m), EV.basis_events(basis), EV.book_events(book), EV.liquidation_events(liq)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tidy(out.drop("metadata"))


@query(
    """SELECT o_orderkey, round(o_totalprice - 1, 6) AS best_bid, round(o_totalprice + 1, 6) AS best_ask, round((o_custkey % 7 + 1) + 3.0, 6) AS bid_size, round((o_custkey % 5 + 1) * 1.0, 6) AS ask_size FROM orders WHERE o_totalprice IS NOT NULL"""
)
def book_levels(spark, d):
    """P10: the books of orders as JSON text, two levels of bids and one of asks within the first two."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet").where("o_totalprice IS NOT NULL")
    n = lambda x: x.cast("string")
    p = F.col("o_totalprice")
    level = lambda price, size: F.array(n(price), n(size))
    book = F.to_json(F.struct(F.array(level(p - 1, F.col("o_custkey") % 7 + 1), level(p - 2, F.lit(3)), level(p - 3, F.lit(99))).alias("bids"), F.array(level(p + 1, F.col("o_custkey") % 5 + 1)).alias("asks")))
    return tidy(o.select("o_orderkey", EV.book_depth(book, 2).alias("_b")).select("o_orderkey", "_b.*"))


@query("SELECT 'C' || o_custkey AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS ts, round(o_totalprice / 1e6, 6) AS funding_rate FROM orders")
def parsed_feed(spark, d):
    """Landed JSON, one row of orders a payload."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    row = F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("instId"), (F.col("o_totalprice") / 1e6).cast("string").alias("fundingRate"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("fundingTime"))
    return tidy(EV.parse_feed(o.select(F.to_json(F.struct(F.array(row).alias("data"))).alias("payload")), "funding"))


_WIDE = ("click", "error", "purchase", "signup", "view")
_PIVOT = ", ".join(f"arg_max(value, source) FILTER (signal_type = '{t}') AS {t}" for t in _WIDE)
_FILL = ", ".join(f"last_value({t} IGNORE NULLS) OVER {S.UP_TO} AS {t}" for t in _WIDE)
#: One event for each (symbol, minute, type, source), so that the last source is unique.
FRAME = f"{CONTEXT}, one AS (SELECT symbol, ts, signal_type, source, max(value) AS value FROM ctx GROUP BY ALL), wide AS (SELECT symbol, ts, {_PIVOT} FROM one GROUP BY symbol, ts), filled AS (SELECT symbol, ts, {_FILL} FROM wide)"


def unique_context(spark, d) -> DataFrame:
    return context_events(spark, d).groupBy("symbol", "ts", "signal_type", "source").agg(F.max("value").alias("value"))


@query(f"WITH {FRAME} SELECT symbol, ts, {S.r(*_WIDE)} FROM filled")
def context_wide(spark, d):
    """A15, W20."""
    return tidy(EV.context_frame(unique_context(spark, d), _WIDE))


_TAGGED = f"""{FRAME}, tagged AS (SELECT symbol, ts, (click - 20) / 1000 AS funding_rate, error AS spread_bps, (view - 20) / 40 AS depth_imbalance FROM filled),
tags AS (SELECT *, list_filter([CASE WHEN abs(funding_rate) >= 0.01 THEN 'funding_extreme' END, CASE WHEN depth_imbalance <= -0.25 OR funding_rate <= -0.008 THEN 'risk_off' END, CASE WHEN spread_bps >= 25 THEN 'thin_liquidity' END], lambda x: x IS NOT NULL) AS tags FROM tagged)"""


def tagged_context(spark, d) -> DataFrame:
    wide = EV.context_frame(unique_context(spark, d), _WIDE)
    rows = wide.select("symbol", "ts", ((F.col("click") - 20) / 1000).alias("funding_rate"), F.col("error").alias("spread_bps"), ((F.col("view") - 20) / 40).alias("depth_imbalance"))
    # the events have no liquidations: depth stands for them
    rows = rows.withColumn("liquidation_imbalance", F.col("depth_imbalance"))
    return rows.withColumn("tags", EV.context_tags(0.01, 25.0, -0.25, -0.008)).drop("liquidation_imbalance")


@query(f"WITH {_TAGGED}, g AS (SELECT *, list_contains(tags, 'thin_liquidity') AS tags_pass FROM tags) SELECT symbol, ts, array_to_string(tags, '|') AS tags, tags_pass, {S.r('CASE WHEN tags_pass THEN spread_bps END AS spread_bps', 'CASE WHEN tags_pass THEN depth_imbalance END AS depth_imbalance', 'spread_bps AS raw_spread_bps', 'depth_imbalance AS raw_depth_imbalance')} FROM g")
def context_gate_ready(spark, d):
    """P12, P13."""
    out = EV.gate_ready(tagged_context(spark, d), ["thin_liquidity"]).withColumn("tags", F.array_join("tags", "|"))
    return tidy(out.drop("funding_rate"))


@query(f"WITH {_TAGGED} SELECT symbol, ts, {S.r('spread_bps', 'depth_imbalance')} FROM tags WHERE spread_bps <= 20 AND depth_imbalance BETWEEN -0.3 AND 0.5")
def context_optimizer_filter(spark, d):
    """P14."""
    return tidy(EV.optimizer_filter(tagged_context(spark, d), 20.0, -0.3, 0.5).select("symbol", "ts", "spread_bps", "depth_imbalance"))


@query(f"WITH {S.BARS}, s AS (SELECT * FROM bars WHERE ts BETWEEN 1704412800 AND 1705017600 AND symbol = 'click') SELECT symbol, ts, {S.r('close', S.roll('avg', 'close', 5) + ' AS sma_5')} FROM s")
def sliced_before_features(spark, d):
    """The range is cut before the window, so its warm-up is lost."""
    b = M.bars(spark, d).where(F.col("ts").between(F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-12"))) & (F.col("symbol") == "click"))
    return tidy(b.select("symbol", "ts", "close", rolling(F.avg, F.col("close"), 5).alias("sma_5")))


# joins
_PROBE = "pr AS (SELECT 'U' || (o_custkey % 3) AS symbol, o_orderkey, 1704067200 + (o_orderkey * 173) % 2592000 AS ts FROM orders)"


def probes(spark, d) -> DataFrame:
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    return o.select(F.concat(F.lit("U"), (F.col("o_custkey") % 3).cast("string")).alias("symbol"), "o_orderkey", F.timestamp_seconds(1704067200 + (F.col("o_orderkey") * 173) % 2592000).alias("ts"))


_ASOF = f"WITH {FRAME}, {_PROBE} SELECT pr.symbol, o_orderkey, pr.ts, filled.ts AS context_ts, {S.r('click AS ctx_click', 'view AS ctx_view')} FROM pr ASOF LEFT JOIN filled ON pr.symbol = filled.symbol AND pr.ts >= filled.ts"


@query(_ASOF)
def asof_context(spark, d):
    """Each probe with the context at or before it."""
    ctx = EV.context_frame(unique_context(spark, d), _WIDE).select("symbol", "ts", "click", "view")
    return tidy(J.asof(probes(spark, d), ctx, prefix="ctx_").select("symbol", "o_orderkey", "ts", "context_ts", "ctx_click", "ctx_view"))


@query(_ASOF)
def asof_context_blocks(spark, d):
    """J1 with blocks of a day."""
    ctx = EV.context_frame(unique_context(spark, d), _WIDE).select("symbol", "ts", "click", "view")
    return tidy(J.asof(probes(spark, d), ctx, prefix="ctx_", hours=24).select("symbol", "o_orderkey", "ts", "context_ts", "ctx_click", "ctx_view"))


@query(f"WITH {FRAME}, {_PROBE}, j AS (SELECT pr.symbol, pr.ts, filled.ts AS c FROM pr ASOF LEFT JOIN filled ON pr.symbol = filled.symbol AND pr.ts >= filled.ts) SELECT symbol, count(*) AS n_rows, count(c) AS n_matched, count(*) FILTER (c > ts) AS n_future FROM j GROUP BY symbol")
def asof_no_leak(spark, d):
    """J9."""
    ctx = EV.context_frame(unique_context(spark, d), _WIDE).select("symbol", "ts", "click")
    return J.no_leak(J.asof(probes(spark, d), ctx))


_GATE_CTX = "gc AS (SELECT symbol, ts + 1800 AS ts, (high - low) * 10 AS spread_bps, (volume - 3) / 6 AS depth_imbalance FROM bars WHERE volume >= 2)"


def gate_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    b = M.bars(spark, d)
    signals = SG.rsi_momentum(b, variant="long-flat").withColumn("signal", F.when(F.col("rsi") >= 60, 1).when(F.col("rsi") < 50, 0)).select("symbol", "ts", "close", "signal")
    context = b.where("volume >= 2").select("symbol", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"), ((F.col("high") - F.col("low")) * 10).alias("spread_bps"), ((F.col("volume") - 3) / 6).alias("depth_imbalance"))
    return signals, context


GATED = f"""{S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, {_GATE_CTX}, sg AS (SELECT symbol, ts, close, CASE WHEN rsi >= 60 THEN 1 WHEN rsi < 50 THEN 0 END AS raw_signal FROM rs),
jg AS (SELECT sg.*, gc.ts AS context_ts, spread_bps, depth_imbalance FROM sg ASOF LEFT JOIN gc ON sg.symbol = gc.symbol AND sg.ts >= gc.ts),
gated AS (SELECT *, CASE WHEN raw_signal = 1 THEN spread_bps IS NOT NULL AND depth_imbalance IS NOT NULL AND coalesce(spread_bps <= 300 AND depth_imbalance BETWEEN -0.2 AND 1, FALSE) ELSE TRUE END AS ok FROM jg)"""


@query(f"WITH {GATED} SELECT symbol, ts, CAST(raw_signal AS BIGINT) AS raw_signal, ok AS context_gate_pass, CAST(CASE WHEN raw_signal = 1 AND NOT ok THEN NULL ELSE raw_signal END AS BIGINT) AS signal FROM gated")
def context_gate(spark, d):
    """J3."""
    signals, context = gate_inputs(spark, d)
    return tidy(J.gate(signals, context, max_spread=300.0, depth=(-0.2, None)).select("symbol", "ts", "raw_signal", "context_gate_pass", "signal"))


@query(
    f"""WITH {GATED.replace('(volume - 3) / 6 AS depth_imbalance', 'CASE WHEN volume <> 3 THEN (volume - 3) / 6 END AS depth_imbalance')}, o AS (SELECT *, CASE WHEN raw_signal = 1 AND spread_bps IS NOT NULL AND depth_imbalance IS NOT NULL THEN spread_bps <= 200 AND depth_imbalance BETWEEN 0 AND 0.5 ELSE TRUE END AS pass FROM gated)
SELECT symbol, ts, CAST(raw_signal AS BIGINT) AS raw_signal, pass AS context_gate_pass, CAST(CASE WHEN pass THEN raw_signal END AS BIGINT) AS signal FROM o"""
)
def context_gate_open(spark, d):
    """J3 that lets entries without context pass; the depth is missing at times."""
    signals, context = gate_inputs(spark, d)
    context = context.withColumn("depth_imbalance", F.when(F.col("depth_imbalance") != 0, F.col("depth_imbalance")))
    return tidy(J.gate(signals, context, max_spread=200.0, depth=(0.0, 0.5), suppress_missing=False).select("symbol", "ts", "raw_signal", "context_gate_pass", "signal"))


@query(f"WITH {S.BARS}, f AS (SELECT symbol, ts, (close - 120) / 10 AS p FROM bars WHERE volume > 2), j AS (SELECT b.symbol, b.ts, coalesce(p, 0.0) AS p FROM bars b LEFT JOIN f ON b.symbol = f.symbol AND b.ts = f.ts) SELECT symbol, ts, round(p, 6) AS prediction_value, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS signal FROM j")
def forecast_signals(spark, d):
    """J4, S13."""
    b = M.bars(spark, d)
    f = b.where("volume > 2").select("symbol", "ts", ((F.col("close") - 120) / 10).alias("prediction_value"))
    return tidy(J.forecast_signal(b, f, 0.5).select("symbol", "ts", "prediction_value", "signal"))


@query(f"WITH {S.BARS}, a AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = 5) SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE ts IN (SELECT ts FROM a)")
def aligned_symbols(spark, d):
    """J5."""
    return tidy(J.aligned(M.bars(spark, d), 5).select("symbol", "ts", "close"))


@query(f"WITH {S.MARKET} SELECT symbol, ts, available_at, {S.r('close', 'spot_close', 'funding_rate', 'open_interest', 'basis', 'basis_bps')}, funding_available_at, oi_available_at FROM market")
def market_dataset(spark, d):
    """J6."""
    return tidy(M.market(spark, d).select("symbol", "ts", "available_at", "close", "spot_close", "funding_rate", "open_interest", "basis", "basis_bps", "funding_available_at", "oi_available_at"))


@query(
    f"""WITH {S.BARS}, slow AS (SELECT symbol, CAST(floor(ts / 14400) AS BIGINT) * 14400 + 14400 AS close_time, arg_max(close, ts) AS slow_close FROM bars GROUP BY 1, 2), fast AS (SELECT symbol, ts, ts + 3600 AS close_time, close FROM bars)
SELECT fast.symbol, fast.ts, round(fast.close, 6) AS close, round(slow_close, 6) AS slow_close FROM fast ASOF LEFT JOIN slow ON fast.symbol = slow.symbol AND fast.close_time >= slow.close_time"""
)
def multi_timeframe(spark, d):
    """Each hourly bar with the last four-hour bar that had closed."""
    b = M.bars(spark, d)
    slow = M.resample(b, "4 hours").select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("close_time"), F.col("close").alias("slow_close"))
    fast = b.select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("close_time"), "close")
    return tidy(J.asof(fast, slow, on="close_time").select("symbol", "ts", "close", "slow_close"))


@query(f"WITH {CONTEXT}, one AS (SELECT symbol, ts, signal_type, max(value) AS value FROM ctx WHERE historical_integrity GROUP BY ALL), {_PROBE}, p0 AS (SELECT DISTINCT symbol, ts FROM pr), p1 AS (SELECT p0.*, o.value AS click FROM p0 ASOF LEFT JOIN (SELECT * FROM one WHERE signal_type = 'click') o ON p0.symbol = o.symbol AND p0.ts >= o.ts), p2 AS (SELECT p1.*, o.value AS view FROM p1 ASOF LEFT JOIN (SELECT * FROM one WHERE signal_type = 'view') o ON p1.symbol = o.symbol AND p1.ts >= o.ts) SELECT symbol, ts, round(click, 6) AS click, round(view, 6) AS view FROM p2")
def point_in_time_snapshots(spark, d):
    """A probe for each order, events with integrity only."""
    e = context_events(spark, d).where("historical_integrity").groupBy("symbol", "ts", "signal_type").agg(F.max("value").alias("value")).withColumn("historical_integrity", F.lit(True))
    p = probes(spark, d).select("symbol", "ts").distinct()
    return tidy(J.snapshots(e, p, ["click", "view"]))


from . import queries_long, queries_more, queries_research  # noqa: E402, F401  registers the others
