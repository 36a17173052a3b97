"""Backtest algebra: ledgers, trades, fills, sizing, portfolios, Monte Carlo, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, TINY, before, by_time, clean, forward_fill, rolling, safe_div, so_far, stages
from ..functions.indicators import returns
from ..operators import stretches as ST


def cost_rate(fee_bps: float | Column = 0.0, slippage_bps: float | Column = 0.0) -> Column:
    """B2."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return (as_column(fee_bps) + as_column(slippage_bps)) / 1e4


def ledger(df: DataFrame, cost: Column | None = None, capital: float = 1.0, keys=KEYS, long_only: bool = True) -> DataFrame:
    """The signal held until the next, one bar late, its returns, costs and equity.

    long_only keeps positions within 0..1, so shorts are flat; without it they are kept within -1..1.
    """
    cost = F.lit(0.0) if cost is None else cost
    held = F.coalesce(forward_fill(F.col("signal").cast("double"), keys), F.lit(0.0))
    target = F.greatest(F.lit(0.0 if long_only else -1.0), F.least(F.lit(1.0), held))
    df = stages(df, {"target_position": target, "asset_return": F.coalesce(returns(F.col("close"), 1, keys), F.lit(0.0))}, {"position": F.coalesce(before(F.col("target_position"), 1, keys), F.lit(0.0))})
    turnover = F.abs(F.col("position") - F.coalesce(before(F.col("position"), 1, keys), F.lit(0.0)))
    df = df.withColumns({"turnover": turnover, "gross_return": F.col("position") * F.col("asset_return")})
    df = df.withColumn("cost_return", F.col("turnover") * cost)
    df = df.withColumn("net_return", F.col("gross_return") - F.col("cost_return"))
    equity = F.product(1 + F.col("net_return")).over(so_far(keys)) * capital
    return df.withColumns({"equity": equity, "is_exposed": F.col("position") != 0})


def ledger_in_stretches(df: DataFrame, cost: Column | None = None, capital: float = 1.0, keys=KEYS, long_only: bool = True, seconds: int = ST.WEEK) -> DataFrame:
    """The rows of ledger(), and their peak and drawdown, without a window over a whole history.

    One scan carries the signal held, its target one row before, and the close into each stretch; another the equity.
    """
    cost = F.lit(0.0) if cost is None else cost
    low = F.lit(0.0 if long_only else -1.0)
    clip = lambda x: F.greatest(low, F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    w = ST.inside(keys)
    df = ST.with_stretch(df, seconds).withColumn("_h", F.last(F.col("signal").cast("double"), True).over(ST.inside_so_far(keys))).withColumn("_h1", F.lag("_h").over(w))

    def last(_, before) -> dict[str, Column]:
        return {"_held": F.last("__h", True).over(before)}

    def previous(order, _) -> dict[str, Column]:
        # what was held at the last row but one so far: a stretch of one row has none of its own
        at_end = F.when(F.col("__n") > 1, F.coalesce("__h1", "_held")).otherwise(F.col("_held"))
        return {"_held1": F.lag(at_end).over(order), "_close": F.lag("__close").over(order)}

    sums = {"__n": F.count("*"), "__h": F.max_by("_h", "ts"), "__h1": F.max_by("_h1", "ts"), "__close": F.max_by("close", "ts")}
    df = ST.carried(df, sums, last, previous, keys=keys).withColumn("_i", F.row_number().over(w))
    df = df.withColumns({"target_position": clip(F.coalesce("_h", "_held")), "asset_return": F.coalesce(safe_div(F.col("close"), F.coalesce(F.lag("close").over(w), F.col("_close"))) - 1, F.lit(0.0))})
    df = df.withColumn("position", F.when(F.col("_i") == 1, clip(F.col("_held"))).otherwise(F.lag("target_position").over(w)))
    was = F.when(F.col("_i") == 1, clip(F.col("_held1"))).otherwise(F.lag("position").over(w))
    df = df.withColumns({"turnover": F.abs(F.col("position") - was), "gross_return": F.col("position") * F.col("asset_return")})
    df = df.withColumn("cost_return", F.col("turnover") * cost).withColumn("net_return", F.col("gross_return") - F.col("cost_return"))
    df = ST.add_equity(df, F.col("net_return"), capital, keys)
    return df.withColumn("is_exposed", F.col("position") != 0).drop("_s", "_h", "_h1", "_held", "_held1", "_close", "_i")


def add_trades(df: DataFrame, keys=KEYS) -> DataFrame:
    """trade_id of each run of one nonzero position's sign, null outside; numbered from 1 in each key."""
    side = F.signum("position")
    new = (side != 0) & (side != F.coalesce(before(side, 1, keys), F.lit(0.0)))
    return df.withColumn("_new", new.cast("int")).withColumn("trade_id", F.when(F.col("position") != 0, F.sum("_new").over(so_far(keys)))).drop("_new")


def trade_returns(df: DataFrame, keys=KEYS, seconds: int = ST.WEEK) -> DataFrame:
    """The product of asset returns of each run of long positions, whatever their size, gross of costs, the open one included."""
    found = ST.runs(df, F.col("position") > 0, {"_factor": ST.multiplied(1 + F.col("asset_return")), "bars_held": ST.counted()}, {"ts": F.col("ts")}, keys, seconds)
    out = ST.numbered(found.where("state"), "trade_id", keys, seconds, "first_ts")
    return out.select(*keys, "trade_id", (F.col("_factor") - 1).alias("trade_return"), "bars_held")


def trade_log(df: DataFrame, keys=KEYS, seconds: int = ST.WEEK) -> DataFrame:
    """Closed trades, from the close of the first bar with a long position to that of the first one that is flat.

    A short position neither opens nor closes one. Entry prices of 0 or less earn nothing.
    """
    df = ST.add_held(df, {"_in": F.when(F.col("position") > 0, True).when(F.col("position") == 0, False)}, keys, seconds)
    found = ST.runs(df, F.coalesce("_in", F.lit(False)), {"bars_held": ST.counted()}, {"ts": F.col("ts"), "close": F.col("close")}, keys, seconds)
    closed = ST.numbered(found.where("state AND next_ts IS NOT NULL"), "trade_id", keys, seconds, "first_ts")
    entry, leave = F.col("first_close"), F.col("next_close")
    pct = F.when(entry > 0, (leave - entry) / F.when(entry > 0, entry)).otherwise(0.0)
    return closed.select(*keys, "trade_id", F.col("first_ts").alias("entry_time"), F.col("next_ts").alias("exit_time"), entry.alias("entry_price"), leave.alias("exit_price"), "bars_held", F.lit(1).alias("side"), (leave - entry).alias("pnl"), pct.alias("pnl_percent"))


def flip_trades(df: DataFrame, keys=KEYS, seconds: int = ST.WEEK) -> DataFrame:
    """Runs of one position's sign, longs and shorts, with their equity result net of costs.

    The equity before a run is that after it without its own returns: the runs need no row from before them.
    """
    found = ST.runs(df, F.signum("position"), {"_factor": ST.multiplied(1 + F.col("net_return"))}, {"ts": F.col("ts"), "position": F.col("position")}, keys, seconds)
    out = ST.numbered(found.where("state != 0"), "trade_id", keys, seconds, "first_ts")
    return out.select(*keys, "trade_id", F.col("last_position").alias("side"), F.col("first_ts").alias("entry_time"), F.col("last_ts").alias("exit_time"), (F.col("_factor") - 1).alias("pnl"))


def fills(df: DataFrame, keys=KEYS) -> DataFrame:
    """A fill for each change of position, numbered in each key."""
    df = df.withColumn("_delta", F.col("position") - F.coalesce(before(F.col("position"), 1, keys), F.lit(0.0))).where("_delta != 0")
    number = F.row_number().over(by_time(keys))
    return df.select(F.format_string("%s-%d", F.concat_ws(":", *keys), number).alias("order_id"), *keys, F.when(F.col("_delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("_delta").alias("quantity"), F.col("close").alias("price"), "ts")


def exports(df: DataFrame, keys=KEYS) -> dict[str, DataFrame]:
    """Weights, portfolio state and daily returns of a ledger."""
    day = F.to_date("ts")
    return {
        "weights": df.select("ts", *keys, F.col("target_position").alias("weight"), (F.col("target_position") != 0).alias("selected")),
        "state": df.select("ts", *keys, "equity", "position", "turnover"),
        "daily": df.groupBy(*keys, day.alias("date")).agg((F.product(1 + F.col("net_return")) - 1).alias("daily_return")),
    }


def sized_ledger(df: DataFrame, mode: str = "BINARY", size: float = 1.0, capital: float = 10_000.0, maker: bool = False, maker_bps: float = 2.0, taker_bps: float = 5.0, slippage_bps: float = 1.0, step: float = 1e-3, least: float = 0.0, lag_bars: int = 0, charge_exits: bool = True, funding_hours: int = 0, keys=KEYS) -> DataFrame:
    """A ledger of quantities without margin.

    BINARY holds `size` units while the signal is positive, FIXED_QTY always, FIXED_NOTIONAL size / close units; quantities
    are rounded half to even to `step` and are 0 under `least`. FRACTIONAL_EQUITY holds that share of equity, so equity is a running
    product of 1 + size * return and quantity follows it, unrounded. A signal counts from its own bar (lag_bars 0).
    Fees and slippage are charged on changes (only on entries without charge_exits); longs receive funding_rate on their
    notional once whenever an hour that is a multiple of funding_hours begins.
    """
    if mode not in ("BINARY", "FIXED_NOTIONAL", "FIXED_QTY", "FRACTIONAL_EQUITY"):
        raise ValueError(f"no sizing {mode}")
    signal = F.coalesce(forward_fill(F.col("signal").cast("double"), keys), F.lit(0.0))
    df = df.withColumn("_signal", signal)
    s = F.coalesce(before(F.col("_signal"), lag_bars, keys), F.lit(0.0)) if lag_bars else F.col("_signal")
    change = F.coalesce(F.col("close") - before(F.col("close"), 1, keys), F.lit(0.0))
    rate = ((maker_bps if maker else taker_bps) + slippage_bps) / 1e4
    if mode == "FRACTIONAL_EQUITY":
        df = df.withColumn("_growth", 1 + size * F.coalesce(returns(F.col("close"), 1, keys), F.lit(0.0)))
        df = df.withColumn("equity", F.product("_growth").over(so_far(keys)) * capital)
        return df.withColumns({"quantity": F.col("equity") * size / F.col("close"), "pnl": change * before(F.col("equity") * size / F.col("close"), 1, keys)}).drop("_growth", "_signal")
    raw = {"BINARY": F.when(s > 0, F.lit(float(size))).otherwise(0.0), "FIXED_QTY": F.lit(float(size)), "FIXED_NOTIONAL": F.lit(float(size)) / F.col("close")}[mode]
    quantity = F.rint(raw / step) * step
    df = df.withColumn("quantity", F.when(F.abs(quantity) < least, 0.0).otherwise(quantity))
    q, was = F.col("quantity"), F.coalesce(before(F.col("quantity"), 1, keys), F.lit(0.0))
    traded = F.abs(q - was) if charge_exits else F.greatest(q - was, F.lit(0.0))
    df = df.withColumns({"pnl": q * change, "fee": traded * F.col("close") * rate, "funding": F.lit(0.0)})
    if funding_hours:
        slot = F.floor(F.unix_timestamp("ts") / (3600 * funding_hours))
        due = slot != before(slot, 1, keys)
        df = df.withColumn("funding", F.when(F.coalesce(due, F.lit(False)), q * F.col("close") * F.coalesce("funding_rate", F.lit(0.0))).otherwise(0.0))
    return df.withColumn("equity", capital + F.sum(F.col("pnl") - F.col("fee") + F.col("funding")).over(so_far(keys))).drop("_signal")


def portfolio(df: DataFrame, kind: str = "equal", n: int = 20, keys=KEYS) -> DataFrame:
    """Portfolio return at each time of net_return by symbol: equal weights, equal among those with a signal, or inverse volatility
    of net_return, where a volatility that is missing or 0 weighs 1."""
    on = F.coalesce(F.col("signal") != 0, F.lit(False))
    if kind == "equal":
        weight = F.lit(1.0)
    elif kind == "active":
        weight = on.cast("double")
    elif kind == "inverse_vol":
        df = df.withColumn("_vol", rolling(F.stddev_samp, F.col("net_return"), n, keys))
        weight = F.coalesce(safe_div(F.lit(1.0), F.when(F.col("_vol") >= TINY, F.col("_vol"))), F.lit(1.0))
    else:
        raise ValueError(f"no weighting {kind}")
    at = df.withColumns({"_w": weight, "_on": on}).groupBy("ts").agg(F.sum(F.col("_w") * F.col("net_return")).alias("_r"), F.sum("_w").alias("_s"), F.count_if("_on").alias("n_active"))
    return at.select("ts", F.coalesce(safe_div(F.col("_r"), F.col("_s")), F.lit(0.0)).alias("portfolio_return"), "n_active")


def monte_carlo(trades: DataFrame, sims: int = 50, seed: int = 7, keys=KEYS) -> DataFrame:
    """Median and 95 % quantile of the maximum drawdown over orders of the trades, each a sort by md5 of seed, run and trade.

    trades: keys, trade_id, trade_return. Every run is a window of its own, so runs are spread over tasks.
    """
    runs = trades.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sim").cast("string"), F.col("trade_id").cast("string")))
    w = Window.partitionBy(*keys, "sim").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_eq", F.product(1 + F.col("trade_return")).over(w)).withColumn("_o", order)
    w = Window.partitionBy(*keys, "sim").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_dd", F.col("_eq") / F.greatest(F.max("_eq").over(w), F.lit(1.0)) - 1)
    worst = runs.groupBy(*keys, "sim").agg(F.min(F.least(F.col("_dd"), F.lit(0.0))).alias("dd"))
    return worst.groupBy(*keys).agg(F.percentile(-F.col("dd"), 0.5).alias("dd_q50"), F.percentile(-F.col("dd"), 0.95).alias("dd_q95"))


def contract(metrics: DataFrame, max_drawdown: float = -0.16, max_daily: float = -0.08, min_cagr: float = 0.0) -> DataFrame:
    """Whether the metrics keep the floors, and which they break."""
    reasons = F.array_compact(F.array(F.when(F.col("max_drawdown") < max_drawdown, "max_drawdown"), F.when(F.col("max_daily_drawdown") < max_daily, "max_daily_drawdown"), F.when(F.col("cagr") < min_cagr, "cagr")))
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def pipeline_gate(metrics: DataFrame, min_trades: int = 30, max_drawdown: float = 0.25, min_pf: float = 1.0, min_sharpe: float = 0.0, min_return: float = 0.0) -> DataFrame:
    """Gate on trades, drawdown, profit factor, Sharpe ratio and return; a warning for fewer than 50 trades, but some.

    Needs trade_count, win_rate and profit_factor; without a loss the factor is infinite if there is a profit, else 0.
    """
    pf = F.coalesce(clean(F.col("profit_factor")), F.when(F.col("win_rate") > 0, float("inf")).otherwise(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("trade_count") < min_trades, "trade_count"), F.when(F.abs("max_drawdown") > max_drawdown, "max_drawdown"), F.when(pf < min_pf, "profit_factor"), F.when(F.col("smart_sharpe") < min_sharpe, "sharpe"), F.when(F.col("cumulative_return") < min_return, "cumulative_return")))
    return metrics.withColumns({"gate_reasons": reasons, "low_trades": (F.col("trade_count") > 0) & (F.col("trade_count") < 50)}).withColumn("gate_passed", F.size("gate_reasons") == 0)
