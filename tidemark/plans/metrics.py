"""Performance metrics as aggregates of ledgers: one row for each key, nothing collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, TINY, before, clean, safe_div, so_far
from ..operators import stretches as ST

YEAR_DAYS = 365.0


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def daily(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """A3: first, lowest and last equity of each day, with the day's drawdown and return."""
    days = ledger.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.min_by("equity", "ts").alias("open_eq"), F.min("equity").alias("min_eq"), F.max_by("equity", "ts").alias("close_eq"))
    change = {"daily_dd": safe_div(F.col("min_eq"), F.col("open_eq")) - 1, "daily_return": safe_div(F.col("close_eq"), F.col("open_eq")) - 1}
    return days.withColumns({k: F.when(F.abs(x) < TINY, 0.0).otherwise(x) for k, x in change.items()})  # a flat day's rounding is no loss


def losing_streak(days: DataFrame, keys=KEYS, seconds: int = 64 * 86400) -> DataFrame:
    """A5: the most losing days in a row, from runs put together over stretches."""
    found = ST.runs(days, F.coalesce(F.col("daily_return") < 0, F.lit(False)), {"_n": ST.counted()}, {"date": F.col("date")}, keys, seconds, "date")
    return found.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("state"), F.col("_n"))), F.lit(0)).alias("max_consecutive_losing_days"))


def metrics(ledger: DataFrame, capital: float = 1.0, keys=KEYS) -> DataFrame:
    """A4: the eleven metrics of each key. A ledger that has its drawdown (see ledger_in_stretches) needs no window by key."""
    if "drawdown" not in ledger.columns:
        ledger = ledger.withColumn("drawdown", safe_div(F.col("equity"), F.max("equity").over(so_far(keys))) - 1)
    whole = ledger.groupBy(*keys).agg(F.max_by("equity", "ts").alias("_last"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400.0).alias("_days"), F.min("drawdown").alias("max_drawdown"), F.avg(F.col("is_exposed").cast("double")).alias("time_in_market"))
    days = daily(ledger, keys)
    r = F.col("daily_return")
    by_day = days.groupBy(*keys).agg(
        F.min("daily_dd").alias("max_daily_drawdown"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.percentile(r, 0.95).alias("_p95"), F.percentile(r, 0.05).alias("_p5"), F.sum(F.when(r > 0, r)).alias("_gain"), F.sum(F.when(r < 0, -r)).alias("_pain"),
        F.avg(F.when(r > 0, r)).alias("_win"), F.avg(F.when(r < 0, -r)).alias("_lose"), (F.count_if(r > 0) / F.count(r)).alias("_rate"),
    )
    out = whole.join(by_day, list(keys)).join(losing_streak(days, keys), list(keys))
    last, d, year = F.col("_last"), F.col("_days"), F.sqrt(F.lit(YEAR_DAYS))
    kelly = F.when(F.col("_win").isNull(), 0.0).when(F.col("_lose").isNull(), 1.0).otherwise(F.col("_rate") - (1 - F.col("_rate")) / (F.col("_win") / F.col("_lose")))
    return out.select(
        *keys, (last / capital - 1).alias("cumulative_return"), F.when((d > 0) & (last > 0), F.pow(last / capital, YEAR_DAYS / F.when(d > 0, d)) - 1).otherwise(0.0).alias("cagr"),
        "time_in_market", _zero(F.col("max_drawdown")).alias("max_drawdown"), _zero(F.col("max_daily_drawdown")).alias("max_daily_drawdown"), "max_consecutive_losing_days",
        _zero(safe_div(F.col("_mean"), F.col("_std")) * year).alias("smart_sharpe"), _zero(safe_div(F.col("_mean"), F.col("_down")) * year).alias("smart_sortino"),
        F.abs(safe_div(F.col("_p95"), F.col("_p5"))).alias("tail_ratio"), safe_div(F.col("_gain"), F.col("_pain")).alias("gain_pain_ratio"), kelly.alias("kelly_criterion"),
    )


def bar_metrics(df: DataFrame, ret: str, keys=(), bars_a_year: float = 365 * 6, seconds: int = ST.WEEK) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown of a column of bar returns, of each key or of the table as one, from cells of a stretch each."""
    df, year = df.select(*keys, "ts", F.col(ret).alias("_ret")), bars_a_year**0.5
    worst = ST.worst_drawdown(df, F.col("_ret"), keys, seconds)
    rest = df.groupBy(*keys).agg(F.avg("_ret").alias("_mean"), F.stddev_samp("_ret").alias("_std"), F.count("*").alias("n_bars"))
    out = rest.join(worst, list(keys)) if keys else rest.join(F.broadcast(worst))  # one row each
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") / F.when(F.col("_std") > 0, F.col("_std")) * year).otherwise(0.0)
    return out.select(*keys, F.col("total_return").alias("cumulative_return"), (F.col("_std") * year).alias("annualized_vol"), sharpe.alias("smart_sharpe"), "max_drawdown", "n_bars")


def trade_metrics(trades: DataFrame, ledger: DataFrame, keys=KEYS) -> DataFrame:
    """Win rate, profit factor, trade count and exposure; no losses, no profit factor."""
    x = F.col("trade_return")
    t = trades.groupBy(*keys).agg(F.count("*").alias("trade_count"), F.avg((x > 0).cast("double")).alias("win_rate"), safe_div(F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))).alias("profit_factor"))
    e = ledger.groupBy(*keys).agg(F.avg(F.col("is_exposed").cast("double")).alias("exposure"))
    return e.join(t, list(keys), "left").select(*keys, F.coalesce("trade_count", F.lit(0)).alias("trade_count"), _zero(F.col("win_rate")).alias("win_rate"), "profit_factor", "exposure")


def combine_segments(segments: DataFrame, by=("symbol",)) -> DataFrame:
    """Metrics of out-of-sample segments as one: compounded return, mean Sharpe, worst drawdown, win rate by trades, mean finite profit factor."""
    n = F.col("trade_count")
    return segments.groupBy(*by).agg((F.product(1 + F.col("total_return")) - 1).alias("total_return"), F.avg("sharpe").alias("sharpe"), F.min("max_drawdown").alias("max_drawdown"), _zero(safe_div(F.sum(F.col("win_rate") * n), F.sum(n))).alias("win_rate"), F.avg(clean(F.col("profit_factor"))).alias("profit_factor"), F.sum(n).alias("trade_count"))


#: Symbols of a block, and the fields of a pair's sums.
SYMBOLS = 64
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _crossed(table: pa.Table) -> pa.Table:
    """Sums of each pair of symbols, the first of block _a and the second of block _b, over the times of one range that both have."""
    x = table.to_pandas().pivot_table(index="ts", columns=["_block", "symbol"], values="_x", aggfunc="first")
    a, b = table["_a"][0].as_py(), table["_b"][0].as_py()
    left, right = (x[k] if k in x.columns.get_level_values(0) else None for k in (a, b))
    out = {c: [] for c in ("symbol_a", "symbol_b", *_SUMS)}
    if left is not None and right is not None:
        p, q = left.to_numpy(float), right.to_numpy(float)
        m, k = ~np.isnan(p), ~np.isnan(q)
        p, q, m, k = np.where(m, p, 0.0), np.where(k, q, 0.0), m.astype(float), k.astype(float)
        sums = {"n": m.T @ k, "sx": p.T @ k, "sy": m.T @ q, "sxx": (p * p).T @ k, "syy": m.T @ (q * q), "sxy": p.T @ q}
        i, j = np.nonzero((sums["n"] > 0) & (left.columns.to_numpy()[:, None] < right.columns.to_numpy()[None, :] if a == b else sums["n"] > 0))
        first, second = left.columns.to_numpy()[i], right.columns.to_numpy()[j]
        turned = first > second  # the smaller name comes first
        for c, d in (("sx", "sy"), ("sxx", "syy")):
            u, v = sums[c][i, j], sums[d][i, j]
            out[c], out[d] = np.where(turned, v, u), np.where(turned, u, v)
        out |= {"symbol_a": np.where(turned, second, first), "symbol_b": np.where(turned, first, second), "n": sums["n"][i, j], "sxy": sums["sxy"][i, j]}
    return pa.table({c: pa.array(v, pa.string() if c.startswith("symbol") else pa.float64()) for c, v in out.items()})


def correlations(df: DataFrame, ret: str = "asset_return", seconds: int = ST.WEEK, block: int = SYMBOLS) -> DataFrame:
    """Correlation of each pair of symbols over the times both have.

    Symbols are dealt into blocks and times into ranges; a task takes two blocks in one range as two matrices and gives the
    sums of their products, which are added up by pair. So a row is copied once for each block, not once for each symbol,
    and a task holds two blocks' rows of one range. Values are taken from their symbol's mean, so that sums keep their digits.
    """
    rows = df.select("symbol", "ts", F.col(ret).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    means = rows.groupBy("symbol").agg(F.avg("_x").alias("_mean"))
    blocks = max(1, -(-means.count() // block))
    rows = rows.join(means, "symbol").select("symbol", "ts", (F.col("_x") - F.col("_mean")).alias("_x"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("_block"))
    rows = ST.with_stretch(rows, seconds).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")})
    parts = rows.groupBy("_s", "_a", "_b").applyInArrow(_crossed, "symbol_a string, symbol_b string, " + ", ".join(f"{c} double" for c in _SUMS))
    total = parts.groupBy("symbol_a", "symbol_b").agg(*(F.sum(c).alias(c) for c in _SUMS))
    n, x, y = F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    both = F.when((x > TINY * TINY) & (y > TINY * TINY), F.sqrt(x * y))
    return total.select("symbol_a", "symbol_b", safe_div(F.col("sxy") - F.col("sx") * F.col("sy") / n, both).alias("correlation"), n.cast("long").alias("n_common"))


def attribution(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """Net return of long and of short bars."""
    r, p = F.col("net_return"), F.col("position")
    return ledger.groupBy(*keys).agg(F.sum(F.when(p > 0, r).otherwise(0.0)).alias("long_return"), F.sum(F.when(p < 0, r).otherwise(0.0)).alias("short_return"), F.count_if(p > 0).alias("long_bars"), F.count_if(p < 0).alias("short_bars"))


def period_attribution(ledger: DataFrame, split: str, keys=KEYS, loss: float = -0.05) -> DataFrame:
    """Return, sides, turnover, costs and volatility before and from `split`, and what a loss of the later period under `loss` comes from."""
    post = F.col("ts") >= F.to_timestamp(F.lit(split))
    r, p = F.col("net_return"), F.col("position")
    out = ledger.groupBy(*keys, post.alias("is_post")).agg((F.product(1 + r) - 1).alias("cumulative_return"), F.sum(F.when(p > 0, r).otherwise(0.0)).alias("long_return"), F.sum(F.when(p < 0, r).otherwise(0.0)).alias("short_return"), F.sum("turnover").alias("turnover"), F.sum("cost_return").alias("cost_drag"), _zero(F.stddev_samp(r)).alias("volatility"))
    total = F.col("cumulative_return")
    kind = F.when(total >= loss, "normal_drawdown_within_expected_range").when(F.col("cost_drag") > F.abs(total) * 0.5, "cost_turnover_drag").when(F.abs("short_return") > F.abs("long_return"), "short_side_failure").otherwise("market_regime_shift_to_chop")
    return out.withColumn("failure", F.when(F.col("is_post"), kind))


def position_changes(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """Changes of position and the total turnover."""
    changed = F.coalesce(F.col("position") != before(F.col("position"), 1, keys), F.lit(False))
    return ledger.withColumn("_c", changed).groupBy(*keys).agg(F.count_if("_c").alias("n_changes"), F.sum("turnover").alias("turnover"))


def run_summary(signals: DataFrame, keys=KEYS) -> DataFrame:
    """Counts of signals, entries, exits, suppressed entries and entries into a trade."""
    s = F.col("signal")
    raw = F.col("raw_signal") if "raw_signal" in signals.columns else s
    opened = (s == 1) & (F.coalesce(before(F.col("_held"), 1, keys), F.lit(0)) != 1)
    df = signals.withColumn("_held", F.coalesce(F.last("signal", True).over(so_far(keys)), F.lit(0))).withColumn("_open", F.coalesce(opened, F.lit(False)))
    return df.groupBy(*keys).agg(F.count(s).alias("n_signals"), F.count_if(s == 1).alias("n_entries"), F.count_if(s == 0).alias("n_exits"), F.count_if((raw == 1) & s.isNull()).alias("n_suppressed"), F.count_if("_open").alias("n_trades"))


def deltas(baseline: DataFrame, candidate: DataFrame, names: list[str], keys=KEYS) -> DataFrame:
    """Candidate less baseline."""
    b = baseline.select(*keys, *(F.col(n).alias(f"_{n}") for n in names))
    return candidate.join(b, list(keys)).select(*keys, *((F.col(n) - F.col(f"_{n}")).alias(f"delta_{n}") for n in names))


def equity_summary(ledger: DataFrame, keys=KEYS, bars_a_year: float = 525_600.0) -> DataFrame:
    """Drawdowns in money and share, gross profit and loss of the bars, Sharpe ratio of the bars."""
    df = ledger.withColumns({"_peak": F.max("equity").over(so_far(keys)), "_d": F.col("equity") - before(F.col("equity"), 1, keys), "_r": safe_div(F.col("equity"), before(F.col("equity"), 1, keys)) - 1})
    return df.groupBy(*keys).agg(F.max(F.col("_peak") - F.col("equity")).alias("abs_drawdown"), F.max(safe_div(F.col("_peak") - F.col("equity"), F.col("_peak"))).alias("pct_drawdown"), F.sum(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)).alias("gross_loss"), _zero(safe_div(F.avg("_r"), F.stddev_samp("_r")) * bars_a_year**0.5).alias("bar_sharpe"))
