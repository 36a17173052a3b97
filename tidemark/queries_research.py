"""Registered queries on segments, sweeps, labels, scores, text and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T1
from .plans import ledger as B
from .plans import metrics as A
from .plans import research as R
from .plans import signals as SG
from .queries import CONTEXT, GATED, query, tidy
from .queries import gate_inputs
from .functions import indicators as I
from .queries_more import _CF, _CHOP, _CTX, _UPTO
from .sources import market as M
from .sources.store import scratch, stored

KT = "symbol, ts"


@query(f"WITH {S.BARS} SELECT symbol, CASE WHEN ts < 1705276800 THEN 'train' ELSE 'test' END AS role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars WHERE ts BETWEEN 1704240000 AND 1706400000 GROUP BY 1, 2")
def date_segments(spark, d):
    """R1, R5."""
    out = R.date_segments(M.bars(spark, d), "2024-01-03 00:00:00", "2024-01-15 00:00:00", "2024-01-28 00:00:00")
    return tidy(R.manifest(out, "symbol", "role"))


def _walk(train: int, test: int, step: int, source: str = "bars", name: str = "wf") -> str:
    return f"""{name}_i AS (SELECT *, row_number() OVER {S.P} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {source}),
{name} AS (SELECT * EXCLUDE (i, n, k), k AS fold, CASE WHEN i - k * {step} < {train} THEN 'train' ELSE 'test' END AS role FROM {name}_i, range(1000) f(k) WHERE k * {step} + {train + test} <= n AND i >= k * {step} AND i < k * {step} + {train + test})"""


@query(f"WITH {S.BARS}, {_walk(200, 100, 100)} SELECT symbol, fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM wf GROUP BY ALL")
def walk_forward_folds(spark, d):
    """R2, R5."""
    return tidy(R.manifest(R.walk_forward(M.bars(spark, d), 200, 100, 100), "symbol", "fold", "role"))


@query(f"WITH {S.BARS}, s AS (SELECT *, row_number() OVER {S.P} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), t AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.85) THEN 'validation' ELSE 'holdout' END AS role FROM s) SELECT symbol, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY ALL")
def ratio_segments(spark, d):
    """R3, O3."""
    return tidy(R.manifest(R.ratio_split(M.bars(spark, d), {"train": 0.6, "validation": 0.25, "holdout": 0.15}), "symbol", "role"))


def _labels(h: int, side: str = "1") -> str:
    """CTE lab: each bar with its first touch in the next h, by a join with all of them."""
    return f"""lb AS (SELECT *, row_number() OVER {S.P} AS i, count(*) OVER (PARTITION BY symbol) AS n, {side} AS side FROM bars),
lt AS (SELECT a.symbol, a.i, min(b.i) AS j FROM lb a JOIN lb b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + {h} WHERE CASE WHEN a.side < 0 THEN b.low <= a.close * 0.8 OR b.high >= a.close * 1.2 ELSE b.high >= a.close * 1.2 OR b.low <= a.close * 0.8 END GROUP BY a.symbol, a.i),
lx AS (SELECT a.*, j IS NOT NULL AS hit, coalesce(j, least(a.i + {h}, a.n)) AS e FROM lb a LEFT JOIN lt USING (symbol, i)),
ly AS (SELECT lx.*, b.ts AS ets, b.close AS ec, lx.hit AND CASE WHEN lx.side < 0 THEN b.low <= lx.close * 0.8 ELSE b.high >= lx.close * 1.2 END AS won FROM lx JOIN lb b ON lx.symbol = b.symbol AND b.i = lx.e),
lz AS (SELECT *, CASE WHEN NOT hit THEN ec WHEN won = (side < 0) THEN close * 0.8 ELSE close * 1.2 END AS price FROM ly),
lw AS (SELECT *, CASE WHEN side < 0 THEN close / price - 1 ELSE price / close - 1 END AS move FROM lz),
lab AS (SELECT symbol, ts, CAST(CASE WHEN won THEN 1 WHEN hit THEN -1 ELSE sign(move) END AS BIGINT) AS label, ets AS label_time, price AS label_price, move AS label_return, CAST(e - i AS BIGINT) AS label_bars, CASE WHEN won THEN 'profit_take' WHEN hit THEN 'stop_loss' ELSE 'time' END AS barrier_hit FROM lw)"""


_LAB = f"symbol, ts, label, label_time, {S.r('label_price', 'label_return')}, label_bars, barrier_hit"


def _labelled(spark, d, horizon: int, side=None, **more) -> DataFrame:
    out = R.labels(M.bars(spark, d), 0.2, 0.2, horizon, side=side, **more)
    return tidy(out.select("symbol", "ts", "label", "label_time", "label_price", "label_return", "label_bars", "barrier_hit"))


@query(f"WITH {S.BARS}, {_labels(5)} SELECT {_LAB} FROM lab")
def triple_barrier(spark, d):
    """R4."""
    return _labelled(spark, d, 5)


@query(f"WITH {S.BARS}, {_labels(24)} SELECT {_LAB} FROM lab")
def triple_barrier_join(spark, d):
    """R4 over blocks of 32 bars, so that most horizons cross a border."""
    return _labelled(spark, d, 24, length=32)


@query(f"WITH {S.BARS}, {_labels(200, 'CASE WHEN volume >= 5 THEN 1 WHEN volume = 4 THEN 0 ELSE -1 END')} SELECT {_LAB} FROM lab")
def triple_barrier_sides(spark, d):
    """R4 with a side by row, over 200 bars."""
    v = F.col("volume")
    return _labelled(spark, d, 200, F.when(v >= 5, 1).when(v == 4, 0).otherwise(-1))


_GRID = "grid AS (SELECT p AS rsi_period, u AS rsi_upper, l AS rsi_lower, e AS rsi_exit, f AS fee_bps, 0.0 AS slippage_bps, printf('%.1f/%.1f/%.1f/%.1f/%.1f/0.0', CAST(p AS DOUBLE), u, l, e, f) AS param_id FROM (VALUES (7), (14)) a(p), (VALUES (60.0::DOUBLE), (70.0)) b(u), (VALUES (30.0::DOUBLE), (50.0)) c(l), (VALUES (50.0::DOUBLE), (55.0)) x(e), (VALUES (0.0::DOUBLE), (10.0)) y(f) WHERE l < e AND e < u)"
_SWEEP = f"""{S.BARS}, {S.rsi(7, 's7', flat=100.0)}, {S.rsi(14, 's14', flat=100.0)}, st AS (SELECT symbol, ts, close, 7 AS rsi_period, rsi FROM s7 UNION ALL SELECT symbol, ts, close, 14, rsi FROM s14), {_GRID},
rn AS (SELECT st.symbol || '|' || param_id AS sk, st.*, param_id, rsi_upper, rsi_lower, rsi_exit, fee_bps FROM st JOIN grid USING (rsi_period)),
sg AS (SELECT *, {S.neutral('rsi_upper', 'rsi_lower', 'rsi_exit', 'sk')} AS signal FROM rn), {S.ledger('sg', 'fee_bps / 1e4', 'sk')}, {S.metrics('ledger', 'sk')}, sm AS (SELECT split_part(sk, '|', 1) AS symbol, split_part(sk, '|', 2) AS param_id, * FROM metrics)"""


def _sweep(spark, d, rows: DataFrame | None = None) -> DataFrame:
    params = R.grid(spark, [7, 14], [60.0, 70.0], [30.0, 50.0], [50.0, 55.0], [0.0, 10.0])
    led = R.sweep(M.bars(spark, d) if rows is None else rows, params, [7, 14])
    return A.metrics(led, keys=("symbol", "param_id"))


@query(f"WITH {_SWEEP} SELECT symbol, param_id, {S.r(*S.METRICS)}, max_consecutive_losing_days FROM sm")
def parameter_sweep(spark, d):
    """R6, R8."""
    return tidy(_sweep(spark, d))


@query(f"WITH {_SWEEP} SELECT symbol, param_id, {S.r('cumulative_return')} FROM sm ORDER BY cumulative_return DESC NULLS LAST, symbol, param_id LIMIT 10")
def top_parameters(spark, d):
    """The ten best."""
    return tidy(R.top(_sweep(spark, d), 10).select("symbol", "param_id", "cumulative_return"))


_OBJ = "smart_sharpe + cumulative_return * 0.5 + coalesce(abs(cumulative_return / nullif(max_drawdown, 0)), 0.0) * 0.2 - (CASE WHEN cumulative_return < 0 THEN 5.0 ELSE 0.0 END + CASE WHEN max_drawdown < -0.25 THEN 2.0 ELSE 0.0 END)"


@query(f"WITH {_SWEEP}, o AS (SELECT *, {_OBJ} AS objective FROM sm), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, param_id) AS rk FROM o) SELECT symbol, param_id, {S.r('objective', 'cumulative_return')} FROM k WHERE rk = 1")
def sweep_champions(spark, d):
    """R7."""
    return tidy(R.champions(R.objective(_sweep(spark, d))).select("symbol", "param_id", "objective", "cumulative_return"))


@query(f"WITH f AS (SELECT DISTINCT o_orderpriority, o_custkey % 50, floor(o_totalprice / 10000), o_orderkey % 7 FROM orders) SELECT o_orderpriority, count(*) AS n_distinct FROM f GROUP BY 1")
def distinct_parameters(spark, d):
    """Equal values under other names are one."""
    o = M.utc(spark).read.parquet(f"{d}/orders.parquet")
    params = o.select("o_orderpriority", F.col("o_orderkey").alias("param_id"), (F.col("o_custkey") % 50).alias("rsi_period"), F.floor(F.col("o_totalprice") / 10000).alias("rsi_upper"), (F.col("o_orderkey") % 7).alias("fee_bps"))
    return R.fingerprints(params).groupBy("o_orderpriority").agg(F.count("*").alias("n_distinct"))


#: Runs of the test bars (train, test, hold, cost), of the folds' test bars, and of the parameter sets on the test bars.
_AUDIT = f"""{S.BARS}, sp AS (SELECT *, row_number() OVER {S.P} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS cnt FROM bars), tst AS (SELECT * EXCLUDE (i, cnt, turnover), i < floor(cnt * 0.6) AS is_train FROM sp),
ru AS (SELECT symbol || '|train' AS sk, * FROM tst WHERE is_train UNION ALL SELECT symbol || '|' || k, tst.* FROM tst, (VALUES ('test'), ('hold'), ('cost')) r(k) WHERE NOT is_train),
{S.rsi(14, 'rr', 'ru', flat=100.0, key='sk')}, rg AS (SELECT *, CASE WHEN sk LIKE '%|hold' THEN 1 ELSE {S.neutral(key='sk')} END AS signal, CASE WHEN sk LIKE '%|cost' THEN 0.0015 ELSE 0.0006 END AS rate FROM rr), {S.ledger('rg', 'rate', 'sk', name='rl')}, {S.metrics('rl', 'sk', 'rm0')}, rm AS (SELECT split_part(sk, '|', 1) AS symbol, split_part(sk, '|', 2) AS run, * FROM rm0),
{_walk(200, 100, 100)}, wk AS (SELECT symbol || '|' || fold AS sk, * EXCLUDE (turnover) FROM wf WHERE role = 'test'), {S.rsi(14, 'wr', 'wk', flat=100.0, key='sk')}, wg AS (SELECT *, {S.neutral(key='sk')} AS signal FROM wr), {S.ledger('wg', key='sk', name='wl')}, {S.metrics('wl', 'sk', 'wm')},
ws AS (SELECT split_part(sk, '|', 1) AS symbol, avg(CASE WHEN cumulative_return > 0 THEN 1.0 ELSE 0.0 END) AS w FROM wm GROUP BY 1)"""
_AUDIT_SETS = f"""{S.rsi(7, 'p7', 'tst WHERE NOT is_train', flat=100.0)}, {S.rsi(14, 'p14', 'tst WHERE NOT is_train', flat=100.0)}, ps AS (SELECT symbol, ts, close, 7 AS rsi_period, rsi FROM p7 UNION ALL SELECT symbol, ts, close, 14, rsi FROM p14), {_GRID},
pn AS (SELECT ps.symbol || '|' || param_id AS sk, ps.*, param_id, rsi_upper, rsi_lower, rsi_exit, fee_bps FROM ps JOIN grid USING (rsi_period)), pg AS (SELECT *, {S.neutral('rsi_upper', 'rsi_lower', 'rsi_exit', 'sk')} AS signal FROM pn), {S.ledger('pg', 'fee_bps / 1e4', 'sk', name='pl')}, {S.metrics('pl', 'sk', 'pm')},
pp AS (SELECT split_part(sk, '|', 1) AS symbol, avg(CASE WHEN cumulative_return > 0 THEN 1.0 ELSE 0.0 END) AS p FROM pm GROUP BY 1)"""
_ROB = {
    "sharpe_over_hold": "t.smart_sharpe > h.smart_sharpe", "drawdown_over_hold": "t.max_drawdown > h.max_drawdown", "positive_return": "t.cumulative_return > 0", "profitable_windows": "coalesce(w, 1.0) >= 0.5",
    "broad_neighbourhood": "coalesce(p, 1.0) >= 0.7", "positive_at_high_cost": "c.cumulative_return > 0",
}
_ROB_REASONS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _ROB.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_AUDIT}, {_AUDIT_SETS}, sc AS (SELECT t.symbol, {_ROB_REASONS} AS reasons FROM rm t JOIN rm h ON t.symbol = h.symbol AND t.run = 'test' AND h.run = 'hold' JOIN rm c ON t.symbol = c.symbol AND c.run = 'cost' LEFT JOIN ws ON t.symbol = ws.symbol LEFT JOIN pp ON t.symbol = pp.symbol) SELECT symbol, CAST(len(reasons) AS BIGINT) AS robustness_score, CASE WHEN len(reasons) >= 5 THEN 'robust' WHEN len(reasons) >= 3 THEN 'promising_but_needs_filters' ELSE 'rejected' END AS robustness_class, array_to_string(reasons, '|') AS reasons FROM sc")
def robustness_scores(spark, d):
    """The test split against buying and holding, the folds' test bars, a grid of parameter sets, and a high cost."""
    b = M.bars(spark, d).drop("turnover")
    runs = A.metrics(stored(R.split_runs(b), "ledger"), keys=("symbol", "run"))
    test = R.ratio_split(b, {"train": 0.6, "test": 0.4}).where("role = 'test'").drop("role")
    sets = R.sweep(test, R.grid(spark, [7, 14], [60.0, 70.0], [30.0, 50.0], [50.0, 55.0], [0.0, 10.0]), [7, 14])
    out = R.robustness(runs, R.window_returns(b, SG.RsiParams(), 200, 100, 100), R.total_returns(sets, ("symbol", "param_id")))
    return tidy(out.withColumn("reasons", F.array_join("reasons", "|")))


_MO = """t.smart_sharpe * 3 + greatest(coalesce(pf, 0.0), 0.0) * 2 + coalesce(w, 0.0) * 2 - (greatest(abs(t.max_drawdown) - 0.16, 0.0) * 3 + greatest(abs(t.max_daily_drawdown) - 0.08, 0.0) * 2 + greatest(tv - 1.0, 0.0) + greatest(20.0 - tc, 0.0) * 2
  + greatest(abs(i.smart_sharpe - t.smart_sharpe) - 0.5, 0.0) * 2 + CASE WHEN t.cumulative_return <= 0 THEN 2.0 ELSE 0.0 END)"""
_MO_FAILED = {
    "low_trade_count": "tc < 20", "max_drawdown_exceeded": "abs(t.max_drawdown) > 0.16", "oos_sharpe_below_minimum": "t.smart_sharpe < 0", "is_oos_sharpe_gap_too_large": "abs(i.smart_sharpe - t.smart_sharpe) > 0.5",
    "walk_forward_pass_rate_too_low": "coalesce(w, 0.0) < 0.5", "turnover_too_high": "tv > 1", "profit_factor_too_low": "coalesce(pf, 0.0) < 0", "max_daily_drawdown_exceeded": "abs(t.max_daily_drawdown) > 0.08",
    "oos_return_not_positive": "t.cumulative_return <= 0", "deterministic_validation_failed": "NOT (t.max_drawdown >= -0.16 AND t.max_daily_drawdown >= -0.08 AND t.cagr >= 0)",
}
_MO_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _MO_FAILED.items()) + "], lambda x: x IS NOT NULL), '|')"


@query(
    f"""WITH {_AUDIT}, {S.trades('rl', 'sk', 'rt')}, tm AS (SELECT split_part(rl.sk, '|', 1) AS symbol, sum(turnover) AS tv FROM rl WHERE sk LIKE '%|test' GROUP BY 1),
tt AS (SELECT split_part(sk, '|', 1) AS symbol, count(*) AS n, sum(CASE WHEN trade_return > 0 THEN trade_return ELSE 0.0 END) / nullif(sum(CASE WHEN trade_return < 0 THEN -trade_return ELSE 0.0 END), 0) AS pf FROM rt WHERE sk LIKE '%|test' GROUP BY 1),
mo AS (SELECT t.symbol, {_MO.replace('tc', 'coalesce(n, 0)')} AS score, {_MO_REASONS.replace('tc < 20', 'coalesce(n, 0) < 20')} AS failures FROM rm t JOIN rm i ON t.symbol = i.symbol AND t.run = 'test' AND i.run = 'train' JOIN tm ON t.symbol = tm.symbol LEFT JOIN tt ON t.symbol = tt.symbol LEFT JOIN ws ON t.symbol = ws.symbol)
SELECT symbol, round(score, 6) AS score, failures, failures = '' AS passed FROM mo"""
)
def multi_factor_objective(spark, d):
    """The test split, its gap to training, and the pass rate of the folds' test bars."""
    b, p = M.bars(spark, d).drop("turnover"), SG.RsiParams()
    led = stored(R.split_runs(b, p), "ledger")  # read six times
    m = A.metrics(led, keys=("symbol", "run"))
    train = m.where("run = 'train'").select("symbol", F.col("smart_sharpe").alias("is_sharpe"))
    test = led.where("run = 'test'")
    trades = A.trade_metrics(B.trade_returns(test), test).select("symbol", "trade_count", "profit_factor")
    rate = R.window_returns(b, p, 200, 100, 100).groupBy("symbol").agg(F.avg((F.col("cumulative_return") > 0).cast("double")).alias("walk_forward_pass_rate"))
    turnover = test.groupBy("symbol").agg(F.sum("turnover").alias("turnover"))
    rows = B.contract(m.where("run = 'test'")).withColumnRenamed("passed", "validation_passed").join(train, "symbol").join(trades, "symbol").join(rate, "symbol", "left").join(turnover, "symbol")
    out = R.multi_objective(rows, R.Criteria(min_pass_rate=0.5))
    return tidy(out.select("symbol", "score", F.array_join("failures", "|").alias("failures"), "passed"))


_FIL = f"""{_CTX}, fs AS (SELECT * EXCLUDE (turnover, ret), {S.neutral('60', '40')} AS sig FROM cx),
fb AS ({' UNION ALL '.join(f"SELECT symbol || '|{k}' AS sk, *, CASE WHEN coalesce({c}, FALSE) THEN sig ELSE 0 END AS signal FROM fs" for k, c in _CF.items())}), {S.ledger('fb', key='sk')}, {S.metrics('ledger', 'sk')},
fr AS (SELECT sk, coalesce(count(*) FILTER (signal <> 0) / nullif(count(*) FILTER (sig <> 0), 0), 1.0) AS retention FROM fb GROUP BY sk),
fm AS (SELECT split_part(sk, '|', 1) AS symbol, split_part(sk, '|', 2) AS filter_id, * FROM metrics JOIN fr USING (sk)),
fc AS (SELECT a.symbol, a.filter_id, CASE WHEN a.smart_sharpe > b.smart_sharpe + 1e-9 THEN 1 ELSE 0 END + CASE WHEN a.max_drawdown > b.max_drawdown + 1e-9 THEN 1 ELSE 0 END + CASE WHEN a.retention >= 0.4 THEN 1 ELSE -1 END AS score FROM fm a JOIN fm b ON a.symbol = b.symbol AND b.filter_id = 'unfiltered_champion')"""


@query(f"WITH {_FIL} SELECT symbol, filter_id, CAST(score AS BIGINT) AS score, CASE WHEN filter_id = 'liquidity_stress_disable' THEN 'promising_but_needs_real_context_data' WHEN score >= 2 THEN 'accept_filter_candidate' WHEN score >= 0 THEN 'keep_unfiltered_champion' ELSE 'reject_filter' END AS classification, filter_id <> 'unfiltered_champion' AND row_number() OVER (PARTITION BY symbol ORDER BY filter_id = 'unfiltered_champion', score DESC, filter_id) = 1 AS selected FROM fc")
def filter_selection(spark, d):
    """The seven context filters; liquidity stress stands for a context that isn't real."""
    base = I.add_context(I.add_rsi(M.bars(spark, d))).drop("turnover").withColumn("signal", SG.rsi_signal("neutral-exit", F.col("rsi_14"), SG.RsiParams(14, 60, 40, 50)))
    out, k = SG.context_runs(base).select("symbol", "ts", "close", "filter_id", "raw_signal", "signal"), ("symbol", "filter_id")
    kept = out.groupBy(*k).agg(F.coalesce(F.try_divide(F.count_if(F.col("signal") != 0), F.count_if(F.col("raw_signal") != 0)), F.lit(1.0)).alias("retention"))
    led = stored(B.ledger(out, B.cost_rate(5.0, 1.0), keys=k), "ledger")  # its metrics read it five times
    m = A.metrics(led, keys=k).join(kept, list(k))
    return tidy(R.filter_scores(m, synthetic=("liquidity_stress_disable",)).select("symbol", "filter_id", "score", "classification", "selected"))


_CHOPS = {"none": "TRUE", "efficiency": "efficiency_ratio >= 0.3", "moderate_vol": "vol_z >= -1 AND vol_z <= 2", "no_high_vol": "vol_z <= 2.5", "cooldown": f"coalesce(max(CAST(loss AS INT)) {_UPTO.format(11)}, 0) = 0"}
_PERIOD = "avg(r) / CASE WHEN stddev_samp(r) > 0 THEN stddev_samp(r) END * sqrt(2190.0)"


@query(
    f"""WITH {_CHOP}, co AS ({' UNION ALL '.join(f"SELECT symbol || '|{k}' AS sk, ts, close, CASE WHEN coalesce({c}, FALSE) THEN sig ELSE 0 END AS signal FROM cl" for k, c in _CHOPS.items())}), {S.ledger('co', key='sk')},
pd AS (SELECT sk, period, ts, net_return AS r, turnover FROM ledger, (VALUES ('full'), ('pre'), ('post')) p(period) WHERE period = 'full' OR (period = 'post') = (ts >= 1705276800)),
pe AS (SELECT *, product(1 + r) OVER (PARTITION BY sk, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM pd), pq AS (SELECT *, eq / max(eq) OVER (PARTITION BY sk, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM pe),
pm AS (SELECT split_part(sk, '|', 2) AS filter_id, period, coalesce({_PERIOD}, 0.0) AS sharpe, min(dd) AS mdd, sum(turnover) AS tv FROM pq GROUP BY sk, period),
m AS (SELECT filter_id, avg(sharpe) FILTER (period = 'full') AS full_sharpe, avg(sharpe) FILTER (period = 'pre') AS pre_sharpe, avg(sharpe) FILTER (period = 'post') AS post_sharpe, avg(mdd) FILTER (period = 'post') AS post_mdd, avg(tv) FILTER (period = 'post') AS post_turnover FROM pm GROUP BY filter_id),
sc AS (SELECT m.*, CASE WHEN m.filter_id = 'none' THEN 0 ELSE CASE WHEN m.post_mdd > b.post_mdd + 1e-9 THEN 1 ELSE 0 END + CASE WHEN m.post_turnover < b.post_turnover * 0.85 - 1e-9 THEN 1 ELSE 0 END + CASE WHEN m.full_sharpe >= b.full_sharpe - 1e-9 THEN 1 ELSE 0 END + CASE WHEN m.pre_sharpe >= b.pre_sharpe * 0.95 - 1e-9 THEN 1 ELSE 0 END END AS score FROM m JOIN m b ON b.filter_id = 'none')
SELECT filter_id, {S.r('full_sharpe', 'pre_sharpe', 'post_sharpe', 'post_mdd', 'post_turnover')}, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, filter_id <> 'none', filter_id) = 1 AS selected FROM sc"""
)
def chop_filter_selection(spark, d):
    """The chop filters on the means over symbols, before and from the fifteenth."""
    base = SG.rsi_momentum(I.add_efficiency(M.bars(spark, d)), SG.RsiParams(14, 60, 40, 50))
    runs = None
    for f in SG.CHOP_FILTERS:
        one = SG.chop_filtered(base, f).select("symbol", "ts", "close", "signal", F.lit(f).alias("filter_id"))
        runs = one if runs is None else runs.unionByName(one)
    led = B.ledger(runs, B.cost_rate(5.0, 1.0), keys=("symbol", "filter_id"))
    late = F.col("ts") >= F.to_timestamp(F.lit("2024-01-15"))
    led = stored(led, "ledger").withColumn("period", F.explode(F.array(F.lit("full"), F.when(late, "post").otherwise("pre"))))
    k = ("symbol", "filter_id", "period")
    m = A.bar_metrics(led, "net_return", k).join(led.groupBy(*k).agg(F.sum("turnover").alias("turnover")), list(k))
    return tidy(R.chop_scores(m))


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, fs AS (SELECT * EXCLUDE (turnover), {S.neutral('60', '40')} AS sig, coalesce(CAST(({S.roll('avg', 'close', 20)}) > ({S.roll('avg', 'close', 50)}) AS INT), 0) AS tr FROM rs), fb AS (SELECT symbol || '|none' AS sk, *, sig AS signal FROM fs UNION ALL SELECT symbol || '|trend', *, sig * tr FROM fs), {S.ledger('fb', key='sk')}, {S.metrics('ledger', 'sk')}, g AS (SELECT a.smart_sharpe AS s, CASE WHEN a.cumulative_return > 0 THEN 1 ELSE 0 END + CASE WHEN a.smart_sharpe > b.smart_sharpe + 1e-9 THEN 1 ELSE 0 END AS points FROM metrics a JOIN metrics b ON split_part(a.sk, '|', 1) = split_part(b.sk, '|', 1) AND a.sk LIKE '%|trend' AND b.sk LIKE '%|none') SELECT CAST(sum(points) AS BIGINT) AS score, round(avg(s), 6) AS average_sharpe, CASE WHEN sum(points) >= 4 THEN 'generalizes' WHEN sum(points) <= 1 THEN 'btc_only' ELSE 'promising_but_mixed' END AS classification FROM g")
def filter_generalisation(spark, d):
    """The trend filter over all symbols."""
    s = SG.rsi_momentum(M.bars(spark, d), SG.RsiParams(14, 60, 40, 50)).drop("turnover")
    a, b = (A.metrics(B.ledger(x, B.cost_rate(5.0, 1.0))) for x in (SG.trend_filtered(s), s))
    return tidy(R.generalisation(a, b))


_EXP = f"""{S.BARS}, {_walk(200, 100, 100)}, xk AS (SELECT symbol || '|' || fold || '|' || role AS sk0, * EXCLUDE (turnover) FROM wf), {S.rsi(14, 'xr', 'xk', flat=100.0, key='sk0')},
xm AS (SELECT sk0 || '|baseline' AS sk, *, CASE WHEN rsi >= 55 THEN 1 WHEN rsi < 50 THEN 0 END AS signal FROM xr UNION ALL SELECT sk0 || '|context', *, CASE WHEN rsi >= 55 THEN CASE WHEN volume > 4 THEN 1 END WHEN rsi < 50 THEN 0 END FROM xr),
{S.ledger('xm', key='sk')}, {S.metrics('ledger', 'sk')}, {S.trades('ledger', 'sk')},
xt AS (SELECT sk, count(*) AS tc, avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(CASE WHEN trade_return > 0 THEN trade_return ELSE 0.0 END) / nullif(sum(CASE WHEN trade_return < 0 THEN -trade_return ELSE 0.0 END), 0) AS pf FROM trades GROUP BY sk),
xe AS (SELECT split_part(sk, '|', 1) AS symbol, CAST(split_part(sk, '|', 2) AS BIGINT) AS fold, split_part(sk, '|', 3) AS role, split_part(sk, '|', 4) AS mode, *, coalesce(tc, 0) AS trade_count, coalesce(wr, 0.0) AS win_rate FROM metrics LEFT JOIN xt USING (sk))"""


def _experiment(spark, d) -> DataFrame:
    wf = R.walk_forward(M.bars(spark, d), 200, 100, 100).drop("turnover")
    return R.experiment(wf, F.col("volume") > 4, SG.RsiParams(14, 55, 30, 50))


@query(f"WITH {_EXP} SELECT symbol, fold, role, mode, {S.r('cumulative_return', 'smart_sharpe', 'max_drawdown', 'win_rate', 'pf AS profit_factor')}, trade_count FROM xe")
def strategy_experiment(spark, d):
    """R13."""
    return tidy(_experiment(spark, d).select("symbol", "fold", "role", "mode", "cumulative_return", "smart_sharpe", "max_drawdown", "win_rate", "profit_factor", "trade_count"))


_PAIR = """xp AS (SELECT b.symbol, b.fold, b.cumulative_return AS br, abs(b.max_drawdown) AS bd, b.smart_sharpe AS bs, b.trade_count AS bt, b.time_in_market AS be, b.win_rate + coalesce(b.pf, 0.0) AS bq, c.cumulative_return AS cr, abs(c.max_drawdown) AS cd, c.smart_sharpe AS cs, c.trade_count AS ct, c.time_in_market AS ce, c.win_rate + coalesce(c.pf, 0.0) AS cq
FROM xe b JOIN xe c ON b.symbol = c.symbol AND b.fold = c.fold AND b.role = 'test' AND c.role = 'test' AND b.mode = 'baseline' AND c.mode = 'context')"""


@query(f"WITH {_EXP}, {_PAIR} SELECT symbol, fold, CASE WHEN cr > br AND cd < bd THEN 'improved' WHEN ct < bt AND cs > bs THEN 'promising' WHEN ce < be AND cq <= bq THEN 'inconclusive' WHEN cr < br AND cs <= bs THEN 'reject' ELSE 'inconclusive' END AS verdict, array_to_string(list_filter([CASE WHEN ct = 0 THEN 'no context trades' END, CASE WHEN bt = 0 THEN 'no baseline trades' END, CASE WHEN ce < 0.01 THEN 'no exposure' END, CASE WHEN cr = br THEN 'same return' END], lambda x: x IS NOT NULL), '|') AS warnings FROM xp")
def experiment_verdicts(spark, d):
    """R12."""
    out = R.compare_modes(_experiment(spark, d))
    return tidy(out.select("symbol", "fold", "verdict", F.array_join("warnings", "|").alias("warnings")))


@query(f"WITH {_EXP} SELECT symbol, mode, {S.r('product(1 + cumulative_return) - 1 AS total_return', 'avg(smart_sharpe) AS sharpe', 'min(max_drawdown) AS max_drawdown', 'coalesce(sum(win_rate * trade_count) / nullif(sum(trade_count), 0), 0.0) AS win_rate', 'avg(pf) AS profit_factor')}, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM xe WHERE role = 'test' GROUP BY 1, 2")
def combined_segments(spark, d):
    """Test segments of each mode as one."""
    t = _experiment(spark, d).where("role = 'test'").withColumnsRenamed({"cumulative_return": "total_return", "smart_sharpe": "sharpe"})
    return tidy(A.combine_segments(t, ("symbol", "mode")))


_ACC = f"""{GATED.replace('BETWEEN -0.2 AND 1', 'BETWEEN -1 AND 1')}, ac AS (SELECT symbol || '|baseline' AS sk, *, raw_signal AS signal FROM gated UNION ALL SELECT symbol || '|candidate', *, CASE WHEN raw_signal = 1 AND NOT ok THEN NULL ELSE raw_signal END FROM gated), {S.ledger('ac', key='sk')}"""


@query(f"WITH {_ACC} SELECT split_part(sk, '|', 1) AS symbol, split_part(sk, '|', 2) AS label, count(*) FILTER (signal = 1) AS n_entries, {S.r('arg_max(equity, ts) - 1 AS total_return', 'sum(turnover) AS turnover')}, CAST(0 AS BIGINT) AS lag_violations, count(*) FILTER (context_ts > ts) AS future_violations FROM ledger GROUP BY sk")
def acceptance_flow(spark, d):
    """R14, L4."""
    signals, context = gate_inputs(spark, d)
    return tidy(R.acceptance(signals, context, 300.0))


_FW_ROLL = lambda f, x, n, least: f"CASE WHEN count({x}) OVER {S.frame(n, 'sk')} >= {least} THEN {f}({x}) OVER {S.frame(n, 'sk')} END"


@query(
    f"""WITH {S.BARS}, f0 AS (SELECT symbol || '|' || CASE WHEN symbol IN ('signup', 'error') THEN 'holdout' ELSE 'forward' END AS sk, * EXCLUDE (turnover) FROM bars WHERE symbol IN ('signup', 'error') OR ts >= 1705276800), {S.rsi(14, 'f1', 'f0', flat=100.0, key='sk')},
f2 AS (SELECT *, ({S.neutral(key='sk')}) * coalesce(CAST(({_FW_ROLL('avg', 'close', 20, 20)}) > ({_FW_ROLL('avg', 'close', 50, 50)}) AS INT), 0) AS sig, close / {S.lag('close', 1, 'sk')} - 1 AS rt FROM f1), f3 AS (SELECT *, {_FW_ROLL('stddev_samp', 'rt', 42, 42)} AS vol FROM f2),
f4 AS (SELECT *, coalesce((vol - {_FW_ROLL('avg', 'vol', 42, 1)}) / CASE WHEN {_FW_ROLL('stddev_samp', 'vol', 42, 1)} >= 1e-12 THEN {_FW_ROLL('stddev_samp', 'vol', 42, 1)} END, 0.0) AS z FROM f3),
f5 AS (SELECT sk || '|baseline' AS sa, ts, close, sig AS signal FROM f4 UNION ALL SELECT sk || '|enhanced', ts, close, CASE WHEN z <= 2.5 THEN sig ELSE 0 END FROM f4), {S.ledger('f5', key='sa')},
f6 AS (SELECT *, net_return AS r, equity / max(equity) OVER (PARTITION BY sa ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM ledger)
SELECT split_part(sa, '|', 1) AS symbol, split_part(sa, '|', 2) AS sample, split_part(sa, '|', 3) AS arm, {S.r('product(1 + r) - 1 AS cumulative_return', 'CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(2190.0) ELSE 0.0 END AS smart_sharpe', 'min(dd) AS max_drawdown')}, count(*) AS n_bars FROM f6 GROUP BY sa"""
)
def forward_validation(spark, d):
    """Three symbols from the fifteenth on, begun anew, and two held out whole."""
    return tidy(R.forward_validation(M.bars(spark, d).drop("turnover"), "2024-01-15 00:00:00", ("signup", "error")))


_TERMS = {"the": 0.5, "and": 1.0, "der": 2.0, "pour": 2.0, "los": 1.5}


@query(
    "WITH f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS ws FROM documents JOIN f USING (doc_id)) SELECT doc_id, CAST(len(list_intersect(ws, ['the', 'and', 'der', 'pour', 'los'])) AS BIGINT) AS overlap, "
    + "round("
    + " + ".join(f"CASE WHEN list_contains(ws, '{t}') THEN {w} ELSE 0.0 END" for t, w in _TERMS.items())
    + ", 6)::DOUBLE AS relevance FROM w"
)
def text_relevance(spark, d):
    """T1, O5."""
    docs = M.utc(spark).read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return tidy(T1.rank(docs, _TERMS))


# streams, run over what is there (availableNow)
SLOTS = 10


def _slot(events: DataFrame, delayed: bool = False):
    """The tenth of the table's time that a row comes in; of the delayed, each row whose event_id 50 divides comes in the next."""
    ends = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("a"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("b")).first()
    low, width = ends["a"] or 0, max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // SLOTS + 1)
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) / width).cast("int")
    return F.least(slot + (F.col("event_id") % 50 == 0).cast("int"), F.lit(SLOTS - 1)) if delayed else slot


def _rocks(spark, run):
    """run() with a state store that transformWithState can use; the session keeps its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _stream(spark, d, build, mode: str = "append", columns=None) -> DataFrame:
    """What build makes of the events, which come as ten files in order of time, a micro-batch each."""
    from .streaming import jobs as ST

    landed = scratch(spark, "landed")
    events = M.utc(spark).read.parquet(f"{d}/events.parquet")
    rows = events.withColumn("_slot", _slot(events))
    ST.land_in_order(rows.select(*(columns or events.columns), "_slot"), landed, F.col("_slot"), SLOTS)
    return _rocks(spark, lambda: ST.drained(build(ST, landed), scratch(spark, "out"), scratch(spark, "state"), mode))


def _ticks(build):
    return lambda ST, folder: build(ST, ST.tick_stream(SparkSession.active(), folder))


def _late(spark, d, build) -> DataFrame:
    """The same with delayed rows: main rows and late rows as one table."""
    from .streaming import jobs as ST

    landed = scratch(spark, "landed")
    events = M.utc(spark).read.parquet(f"{d}/events.parquet")
    ST.land_in_order(events.withColumn("_slot", _slot(events, delayed=True)), landed, F.col("_slot"), SLOTS)
    main, late = _rocks(spark, lambda: ST.drained_with_late(build(ST, ST.tick_stream(spark, landed)), scratch(spark, "out"), scratch(spark, "late"), scratch(spark, "state")))
    return main.unionByName(late).drop("batch")


@query(f"WITH {S.BARS}, m AS (SELECT CAST(floor(max(epoch(ts)) - 600) AS BIGINT) AS w FROM events) SELECT symbol, ts, {S.r('open', 'high', 'low', 'close', 'volume')} FROM bars, m WHERE ts + 3600 <= w")
def stream_bars(spark, d):
    """ST1: bars whose end the watermark has passed."""
    return tidy(_stream(spark, d, _ticks(lambda ST, s: ST.bars(s))))


_TICKS = "tk AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts, epoch_us(ts) AS us, 100 + value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events)"


@query(f"WITH RECURSIVE {_TICKS}, e AS (SELECT symbol, n, price AS ema FROM tk WHERE n = 1 UNION ALL SELECT tk.symbol, tk.n, (2.0 / 21) * price + (1 - 2.0 / 21) * e.ema FROM e JOIN tk ON tk.symbol = e.symbol AND tk.n = e.n + 1) SELECT symbol, ts, {S.r('price', 'ema')}, FALSE AS late FROM tk JOIN e USING (symbol, n)")
def stream_ema(spark, d):
    """ST2 on ticks."""
    return tidy(_stream(spark, d, _ticks(lambda ST, s: ST.indicator(s, ST.EmaState()))))


@query(
    f"""WITH RECURSIVE {_TICKS}, c AS (SELECT *, greatest(coalesce(price - lag(price) OVER (PARTITION BY symbol ORDER BY n), 0), 0) AS u, greatest(coalesce(lag(price) OVER (PARTITION BY symbol ORDER BY n) - price, 0), 0) AS v FROM tk),
w AS (SELECT symbol, CAST(15 AS BIGINT) AS n, sum(u) / 14 AS a, sum(v) / 14 AS b FROM c WHERE n BETWEEN 2 AND 15 GROUP BY symbol UNION ALL SELECT c.symbol, c.n, (w.a * 13 + c.u) / 14, (w.b * 13 + c.v) / 14 FROM w JOIN c ON c.symbol = w.symbol AND c.n = w.n + 1)
SELECT c.symbol, c.ts, {S.r('price', 'CASE WHEN w.b < 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + w.a / w.b) END AS rsi')}, FALSE AS late FROM c LEFT JOIN w USING (symbol, n)"""
)
def stream_wilder_rsi(spark, d):
    """ST3 on ticks."""
    return tidy(_stream(spark, d, _ticks(lambda ST, s: ST.indicator(s, ST.RsiState()))))


_W20 = "OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"WITH {_TICKS}, b AS (SELECT *, CASE WHEN n >= 20 THEN avg(price) {_W20} END AS m, CASE WHEN n >= 20 THEN stddev_pop(price) {_W20} END AS sd FROM tk) SELECT symbol, ts, {S.r('price', 'm AS mean', 'sd AS std', 'm + 2 * sd AS upper', 'm - 2 * sd AS lower')}, FALSE AS late FROM b")
def stream_bands(spark, d):
    """ST4 on ticks."""
    return tidy(_stream(spark, d, _ticks(lambda ST, s: ST.indicator(s, ST.BandState()))))


#: Rows with the slot that they come in, and the latest time that their symbol had in earlier slots.
_SLOTTED = f"""ends AS (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // {SLOTS} + 1 AS w FROM events),
sl AS (SELECT event_type AS symbol, epoch_us(ts) AS us, 100 + value AS price, event_id, least((epoch_us(ts) - a) // w + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, {SLOTS - 1}) AS slot FROM events, ends),
mx AS (SELECT symbol, slot, max(max(us)) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sl GROUP BY symbol, slot),
sm AS (SELECT sl.*, seen FROM sl JOIN mx USING (symbol, slot))"""


@query(
    f"""WITH RECURSIVE {_SLOTTED}, lt AS (SELECT *, coalesce(us <= seen, FALSE) AS late FROM sm), fr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) AS n FROM lt WHERE NOT late),
e AS (SELECT symbol, n, price AS ema FROM fr WHERE n = 1 UNION ALL SELECT fr.symbol, fr.n, (2.0 / 21) * price + (1 - 2.0 / 21) * e.ema FROM e JOIN fr ON fr.symbol = e.symbol AND fr.n = e.n + 1)
SELECT symbol, us // 1000000 AS ts, {S.r('price', 'ema')}, FALSE AS late FROM fr JOIN e USING (symbol, n) UNION ALL SELECT symbol, us // 1000000, round(price, 6), NULL, TRUE FROM lt WHERE late"""
)
def stream_ema_with_late_rows(spark, d):
    """ST2 over ten batches, of which all but the first bring rows of the one before."""
    return tidy(_late(spark, d, lambda ST, s: ST.indicator(s, ST.EmaState())))


@query(
    f"""WITH {_SLOTTED}, lt AS (SELECT *, us // 3600000000 * 3600000000 AS start, coalesce(us // 3600000000 * 3600000000 + 3600000000 <= seen - 600000000, FALSE) AS late FROM sm), top AS (SELECT symbol, max(us) AS latest FROM sl GROUP BY symbol),
b AS (SELECT symbol, start, arg_min(price, us) AS open, max(price) AS high, min(price) AS low, arg_max(price, us) AS close, CAST(count(*) AS DOUBLE) AS volume FROM lt WHERE NOT late GROUP BY symbol, start)
SELECT symbol, start // 1000000 AS ts, {S.r('open', 'high', 'low', 'close', 'volume')}, FALSE AS late FROM b JOIN top USING (symbol) WHERE start + 3600000000 <= latest - 600000000
UNION ALL SELECT symbol, us // 1000000, NULL, NULL, NULL, round(price, 6), NULL, TRUE FROM lt WHERE late"""
)
def stream_bars_with_late_rows(spark, d):
    """ST1 over ten batches: bars by each symbol's own latest time, and the rows that came after their bar."""
    return tidy(_late(spark, d, lambda ST, s: ST.bars_with_late(s)))


def _tagged(s: DataFrame) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("price") > 120, "high"), F.when(F.col("tie") % 2 == 0, "even")))
    return s.select(F.lit("w").alias("workflow"), "symbol", F.lit("tick").alias("timeframe"), "ts", tags.alias("tags"))


_TRIG = f"""WITH RECURSIVE {_TICKS.replace('100 + value AS price', '100 + value AS price, event_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k FROM tk WHERE price > 120 AND event_id % 2 = 0),
f AS (SELECT symbol, k, ts, us AS last_us, TRUE AS fired FROM r WHERE k = 1 UNION ALL SELECT r.symbol, r.k, r.ts, CASE WHEN r.us - f.last_us >= 7200000000 THEN r.us ELSE f.last_us END, r.us - f.last_us >= 7200000000 FROM f JOIN r ON r.symbol = f.symbol AND r.k = f.k + 1)
SELECT 'w' AS workflow, symbol, 'tick' AS timeframe, ts FROM f WHERE fired"""


@query(_TRIG)
def stream_triggers(spark, d):
    """ST5: cooldown of two hours."""
    return tidy(_stream(spark, d, _ticks(lambda ST, s: ST.triggers(_tagged(s), ("high", "even"), 7200.0))))


@query(_TRIG)
def triggers_folded(spark, d):
    """ST5's batch twin, by successor links."""
    from .streaming import jobs as ST

    return tidy(ST.triggers_batch(_tagged(M.ticks(spark, d)), ("high", "even"), 7200.0))


@query(
    """WITH s AS (SELECT 'U' || (user_id % 3) AS symbol, ts AS t, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, 100 + value AS v FROM events WHERE event_id % 5 <> 0)
SELECT symbol, ts, round(last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER w, 6) AS click, round(last_value(CASE WHEN event_type = 'view' THEN v END IGNORE NULLS) OVER w, 6) AS view FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def stream_snapshots(spark, d):
    """ST6; user_id modulo 3 is the symbol."""

    def build(ST, folder):
        schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        e = e.select(F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("signal_type"), (F.lit(100.0) + F.col("value")).alias("value"), (F.col("event_id") % 5 != 0).alias("historical_integrity"))
        return ST.snapshot_stream(e, ("click", "view"))

    return tidy(_stream(spark, d, build))


@query(f"WITH {CONTEXT} SELECT source, symbol, CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n FROM ctx GROUP BY ALL")
def stream_landing(spark, d):
    """ST7: the store that a stream has landed, by partition."""
    from .queries import context_events
    from .streaming import jobs as ST

    landed, path = scratch(spark, "landed"), scratch(spark, "store")
    rows = context_events(spark, d)
    rows.write.parquet(landed)
    q = ST.land(spark.readStream.schema(rows.schema).parquet(landed), path, scratch(spark, "state"))
    q.awaitTermination()
    out = spark.read.parquet(path)
    return out.groupBy("source", "symbol", F.datediff("date", F.lit("1970-01-01")).cast("long").alias("day")).agg(F.count("*").alias("n"))


