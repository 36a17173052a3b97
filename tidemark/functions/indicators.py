"""Indicators as DataFrame transforms: each adds columns, keyed by symbol and ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import KEYS, before, by_time, deviation, last_rows, quantile, rolling, safe_div, so_far, stages, zscore


def returns(x: Column, n: int = 1, keys=KEYS) -> Column:
    """W1."""
    return safe_div(x, before(x, n, keys)) - 1


def log_returns(x: Column, n: int = 1, keys=KEYS) -> Column:
    """W2."""
    return F.ln(safe_div(x, before(x, n, keys)))


def add_returns(df: DataFrame, periods=(1, 5, 15, 60), keys=KEYS) -> DataFrame:
    """W1-W3."""
    df = df.withColumns({f"ret_{n}": returns(F.col("close"), n, keys) for n in periods} | {"log_ret_1": log_returns(F.col("close"), 1, keys)})
    return df.withColumn("abs_ret_1", F.abs("ret_1"))


def add_bands(df: DataFrame, n: int = 20, k: float = 2.0, keys=KEYS) -> DataFrame:
    """Bollinger bands on the population deviation."""
    mid, up, low = (f"bb_{x}_{n}" for x in ("mid", "upper", "lower"))
    df = df.withColumns({mid: rolling(F.avg, F.col("close"), n, keys), "_sd": deviation(F.col("close"), n, keys, population=True)})
    df = df.withColumns({up: F.col(mid) + k * F.col("_sd"), low: F.col(mid) - k * F.col("_sd")})
    width = F.col(up) - F.col(low)
    return df.withColumns({f"bb_width_{n}": safe_div(width, F.col(mid)), f"bb_pos_{n}": safe_div(F.col("close") - F.col(low), width)}).drop("_sd")


def add_reclaims(df: DataFrame, n: int = 20, keys=KEYS) -> DataFrame:
    """Closing back inside a band that the bar (loose) or the close before (strict) was beyond."""
    low, up = F.col(f"bb_lower_{n}"), F.col(f"bb_upper_{n}")
    return df.withColumns(
        {
            "bb_reclaim_lower": (F.col("low") < low) & (F.col("close") > low),
            "bb_reclaim_upper": (F.col("high") > up) & (F.col("close") < up),
            "bb_reclaim_lower_strict": (before(F.col("close"), 1, keys) < before(low, 1, keys)) & (F.col("close") > low),
            "bb_reclaim_upper_strict": (before(F.col("close"), 1, keys) > before(up, 1, keys)) & (F.col("close") < up),
        }
    )


def add_rsi(df: DataFrame, n: int = 14, keys=KEYS, flat: float = 50.0, name: str | None = None) -> DataFrame:
    """Simple rolling RSI; the first bar counts as no change.

    flat: value where the window has neither gains nor losses (50 for features, 100 for the indicator variant).
    """
    change = F.col("close") - before(F.col("close"), 1, keys)
    up = F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0))
    down = F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0))
    df = stages(df, {"_up": up, "_down": down}, {"_up": rolling(F.avg, F.col("_up"), n, keys), "_down": rolling(F.avg, F.col("_down"), n, keys)})
    gain, loss = F.col("_up"), F.col("_down")
    value = F.when(gain.isNull(), None).when((loss < 1e-12) & (gain < 1e-12), flat).when(loss < 1e-12, 100.0).otherwise(100 - 100 / (1 + safe_div(gain, loss)))
    return df.withColumn(name or f"rsi_{n}", value).drop("_up", "_down")


def add_true_range(df: DataFrame, n: int = 14, keys=KEYS) -> DataFrame:
    """True range, its rolling mean, both relative to the close, and the bar's own range."""
    close = before(F.col("close"), 1, keys)
    df = df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close)))
    df = df.withColumn(f"atr_{n}", rolling(F.avg, F.col("true_range"), n, keys))
    return df.withColumns({f"atr_pct_{n}": safe_div(F.col(f"atr_{n}"), F.col("close")), "range_pct": safe_div(F.col("high") - F.col("low"), F.col("close"))})


def add_volatility(df: DataFrame, windows=(20, 60, 240), n: int = 14, keys=KEYS) -> DataFrame:
    """True range and its means, and realised volatility of ret_1 over each window."""
    df = add_true_range(df, n, keys)
    return df.withColumns({f"realized_vol_{w}": deviation(F.col("ret_1"), w, keys) for w in windows})


def add_momentum(df: DataFrame, n: int = 10, slope: int = 5, keys=KEYS) -> DataFrame:
    """Momentum over n and 20 bars, its change over `slope` and 10 bars, distance of the close from its mean, as a share and in deviations."""
    df = df.withColumns({f"momentum_{n}": returns(F.col("close"), n, keys), "momentum_20": returns(F.col("close"), 20, keys)})
    m = F.col(f"momentum_{n}")
    extension = {"price_extension": zscore(F.col("close"), 20, keys), "price_extension_20": safe_div(F.col("close"), rolling(F.avg, F.col("close"), 20, keys)) - 1}
    return df.withColumns({f"momentum_slope_{slope}": m - before(m, slope, keys), "momentum_slope_10": m - before(m, 10, keys), **extension})


def add_volume(df: DataFrame, n: int = 30, keys=KEYS) -> DataFrame:
    """Z-scores over 20, 60 and n bars, and spikes, which are null as long as their z-score is."""
    scores = {"volume_z": zscore(F.col("volume"), n, keys), "volume_zscore_20": zscore(F.col("volume"), 20, keys), "volume_zscore_60": zscore(F.col("volume"), 60, keys)}
    if "turnover" in df.columns:
        scores |= {"turnover_z": zscore(F.col("turnover"), n, keys), "turnover_zscore_20": zscore(F.col("turnover"), 20, keys)}
    return df.withColumns(scores).withColumn("volume_spike_20", F.col("volume_zscore_20") > 2.0)


def add_efficiency(df: DataFrame, n: int = 14, vol: int = 42, keys=KEYS) -> DataFrame:
    """Efficiency ratio, and the z-score of realised volatility."""
    df = stages(df, {"_step": F.abs(F.col("close") - before(F.col("close"), 1, keys)), "_ret": returns(F.col("close"), 1, keys)}, {"_path": rolling(F.sum, F.col("_step"), n, keys), "_vol": deviation(F.col("_ret"), vol, keys)})
    return df.withColumns({"efficiency_ratio": safe_div(F.abs(F.col("close") - before(F.col("close"), n, keys)), F.col("_path")), "vol_z": zscore(F.col("_vol"), vol, keys)}).drop("_step", "_ret", "_path", "_vol")


def add_context(df: DataFrame, keys=KEYS) -> DataFrame:
    """Volatility, its own volatility and z-score, stress, moving-average trend, RSI extremes. Needs rsi_14; a first return is 0."""
    ret = F.coalesce(returns(F.col("close"), 1, keys), F.lit(0.0))
    df = stages(df, {"_ret": ret}, {"realised_vol": deviation(F.col("_ret"), 20, keys)}, {"vol_of_vol": deviation(F.col("realised_vol"), 100, keys), "volatility_zscore": zscore(F.col("realised_vol"), 100, keys)})
    trend = rolling(F.avg, F.col("close"), 20, keys) > rolling(F.avg, F.col("close"), 50, keys)
    return df.withColumns({"liquidity_stress": F.col("volatility_zscore") > 3.0, "trend_up": trend, "rsi_high": F.col("rsi_14") > 80, "rsi_low": F.col("rsi_14") < 20}).drop("_ret")


def add_drawdown(df: DataFrame, x: str = "close", keys=KEYS) -> DataFrame:
    """W16."""
    df = df.withColumn("peak", F.max(x).over(so_far(keys)))
    return df.withColumn("drawdown", safe_div(F.col(x), F.col("peak")) - 1)


def add_td_setup(df: DataFrame, length: int = 9, lag: int = 4, keys=KEYS, number: Column | None = None) -> DataFrame:
    """+1 after `length` closes in a row under the close `lag` bars before, -1 after as many above, from bar length + lag + 1 on.

    number: the bar's number in its history, where df holds a part of it.
    """
    w = last_rows(length, keys)
    number = F.row_number().over(by_time(keys)) if number is None else number
    df = df.withColumns({"_under": (F.col("close") < before(F.col("close"), lag, keys)).cast("int"), "_over": (F.col("close") > before(F.col("close"), lag, keys)).cast("int"), "_n": number})
    ready = F.col("_n") > length + lag  # the first bar that could do it isn't one yet
    full = {"_under": F.sum("_under").over(w), "_over": F.sum("_over").over(w)}
    df = df.withColumns(full)
    return df.withColumn("td_setup", F.when(ready & (F.col("_under") == length), 1).when(ready & (F.col("_over") == length), -1).otherwise(0)).drop("_under", "_over", "_n")


def add_extrema(df: DataFrame, n: int = 3, x: str = "close", keys=KEYS) -> DataFrame:
    """Whether the bar n rows ago was a local high or low, known only now.

    An extremum is at least (most) as high (low) as the n bars on either side; nothing is looked up ahead of its confirmation.
    """
    past, ahead = by_time(keys).rowsBetween(-2 * n, -n - 1), by_time(keys).rowsBetween(-n + 1, 0)
    then, full = before(F.col(x), n, keys), F.count(x).over(by_time(keys).rowsBetween(-2 * n, 0)) == 2 * n + 1
    high = full & (then >= F.max(x).over(past)) & (then >= F.max(x).over(ahead))
    low = full & (then <= F.min(x).over(past)) & (then <= F.min(x).over(ahead))
    return df.withColumns({"is_high": F.coalesce(high, F.lit(False)), "is_low": F.coalesce(low, F.lit(False)), "extremum": F.when(full, then)})


def add_divergence(df: DataFrame, n: int = 20, keys=KEYS, least: float = 0.25, earliest: bool = False) -> DataFrame:
    """The price makes a new extreme of the last n bars and MACD, compared at the two extremes, doesn't, by a strength of at least `least`.

    Needs macd. The extreme before is taken over the n rows before the current one, of equal ones the latest or the
    `earliest`; the strength is MACD's change between the two, as a share of the earlier one (0 where that is 0).
    """
    prior = by_time(keys).rowsBetween(-n, -1)
    full = F.count("macd").over(prior) == n
    m = F.col("macd")
    df = df.withColumn("_row", F.row_number().over(by_time(keys)))
    # which of equal prices min_by and max_by take is open without the row beside the price
    place = F.col("_row") if earliest else -F.col("_row")
    at = lambda x, tie: F.when(F.col(x).isNotNull(), F.struct(F.col(x), tie))
    low_at, high_at = F.min_by("macd", at("low", place)).over(prior), F.max_by("macd", at("high", -place)).over(prior)
    df = df.withColumns({"_bull": F.coalesce(F.abs(safe_div(m - low_at, F.abs(low_at))), F.lit(0.0)), "_bear": F.coalesce(F.abs(safe_div(high_at - m, F.abs(high_at))), F.lit(0.0))})
    bull = full & (F.col("low") < F.min("low").over(prior)) & (m > low_at) & (F.col("_bull") >= least)
    bear = full & (F.col("high") > F.max("high").over(prior)) & (m < high_at) & (F.col("_bear") >= least)
    df = df.withColumns({"bullish_divergence": F.coalesce(bull, F.lit(False)), "bearish_divergence": F.coalesce(bear, F.lit(False))})
    return df.withColumn("divergence_strength", F.when(F.col("bullish_divergence"), F.col("_bull")).when(F.col("bearish_divergence"), F.col("_bear"))).drop("_row", "_bull", "_bear")


def add_trailing_stop(df: DataFrame, atr: Column, long: bool = True, keys=("symbol", "trade_id"), multiple: float = 2.0, share: float = 0.05) -> DataFrame:
    """The stop of a trade, which only tightens: the nearer of a multiple of ATR and a share of the price, off the bar's high (for shorts its low).

    Without an ATR yet the share alone counts.
    """
    w, x = so_far(keys), F.col("high" if long else "low")
    if long:
        df = df.withColumn("stop", F.max(F.greatest(x - atr * multiple, x * (1 - share))).over(w))
    else:
        df = df.withColumn("stop", F.min(F.least(x + atr * multiple, x * (1 + share))).over(w))
    return df.withColumn("stopped", F.coalesce(F.col("low") <= before(F.col("stop"), 1, keys) if long else F.col("high") >= before(F.col("stop"), 1, keys), F.lit(False)))


def cooled(loss: Column, n: int, keys=KEYS) -> Column:
    """Whether none of the last n bars, this one included, was a loss."""
    w = by_time(keys).rowsBetween(-(n - 1), 0)
    return F.coalesce(F.max(loss.cast("int")).over(w), F.lit(0)) == 0


def extreme(z: Column, threshold: float) -> Column:
    """W29."""
    return F.coalesce(F.abs(z) >= threshold, F.lit(False))


def downsample(df: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Every n-th row of each key, with the buy-and-hold curve and its drawdown from all rows."""
    df = df.withColumns({"_n": F.row_number().over(by_time(keys)), "hold": safe_div(F.col("close"), F.first("close").over(so_far(keys)))})
    return add_drawdown(df, "hold", keys).where((F.col("_n") - 1) % n == 0).drop("_n")


def squeeze(df: DataFrame, n: int = 20, lookback: int = 125, q: float = 0.25, keys=KEYS) -> DataFrame:
    """Bollinger width on the sample deviation, at or under its own rolling quantile."""
    df = df.withColumn("_width", safe_div(4 * deviation(F.col("close"), n, keys), rolling(F.avg, F.col("close"), n, keys)))
    return df.withColumn("squeeze", F.coalesce(F.col("_width") <= quantile(F.col("_width"), q, lookback, keys), F.lit(False))).drop("_width")


def squeeze_by_ranks(df: DataFrame, n: int = 20, lookback: int = 125, q: float = 0.25, keys=KEYS) -> DataFrame:
    """squeeze() whose rolling quantile comes from a rank structure, so that long lookbacks cost no more."""
    from ..operators.blocks import Quantile, add_order_statistics

    df = df.withColumn("_width", safe_div(4 * deviation(F.col("close"), n, keys), rolling(F.avg, F.col("close"), n, keys)))
    df = add_order_statistics(df, {"_limit": Quantile("_width", q, lookback)}, keys)
    return df.withColumn("squeeze", F.coalesce(F.col("_width") <= F.col("_limit"), F.lit(False))).drop("_width", "_limit")
