"""Rules of signals, regimes, gates, scores and attribution on literal vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.plans import features as FT
from tidemark.plans import ledger as B
from tidemark.plans import metrics as A
from tidemark.plans import research as R
from tidemark.plans import signals as SG
from tidemark.sources import market as M

START = dt.datetime(2024, 1, 1)


def table(spark, rows, names, kinds):
    data = [(START + dt.timedelta(hours=i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp, " + ", ".join(f"{n} {k}" for n, k in zip(names.split(), kinds.split(), strict=True))).withColumn("symbol", F.lit("X"))


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_funding_reversal(spark):
    names, kinds = "rsi_14 funding_zscore_30 price_extension_20 ret_60 momentum_slope_10 basis_zscore_60 spread_bps", "double " * 7
    rows = [
        (30.0, -2.0, -0.02, 0.0, 0.1, 0.0, 5.0),  # all limits met exactly
        (30.0, -1.9, -0.02, 0.0, 0.1, 0.0, 5.0),
        (30.0, -2.0, -0.019, -1.0, 0.1, 0.0, 5.0),  # ret_60 counts only without the extension
        (30.0, -2.0, -0.02, 0.0, 0.0, -1.5, 5.0),
        (50.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0),
        (70.0, 2.0, 0.0, 0.0, -0.1, 0.0, 5.0),
        (30.0, None, -0.02, 0.0, 0.1, 0.0, 99.0),
    ]
    df = table(spark, rows, names, kinds.strip())
    out = SG.funding_exhaustion_reversal(df)
    assert column(out, "signal") == [1, None, None, None, 0, 0, None]
    assert column(out, "short_setup") == [False] * 5 + [True, False]
    assert column(SG.funding_exhaustion_reversal(df.drop("price_extension_20"), mid_exit=False), "signal") == [None, None, 1, None, None, None, None]
    assert column(SG.funding_exhaustion_reversal(df, turn=False, basis=True), "signal") == [None, None, None, 1, 0, 0, None]
    assert column(SG.funding_exhaustion_reversal(df, context=False, max_spread=50.0), "signal") == [1, 1, None, None, 0, 0, None]
    with pytest.raises(ValueError):
        SG.funding_exhaustion_reversal(df, oversold=80)
    with pytest.raises(ValueError):
        SG.funding_exhaustion_reversal(df.drop("momentum_slope_10"))


def test_oi_trend(spark):
    names = "close ema_20 ema_dist_20 trend_strength_50_200 oi_zscore_60 oi_change_pct_5 funding_zscore_30 basis_zscore_60"
    rows = [
        (11.0, 10.0, 0.1, 0.01, 1.1, -1.0, 1.4, 1.4),  # confirmed by the z-score
        (11.0, 10.0, 0.1, 0.01, None, 0.1, 1.4, 1.4),  # by the change
        (11.0, 10.0, 0.1, 0.01, 1.0, 0.0, 1.4, 1.4),  # by neither
        (11.0, 10.0, 0.1, 0.01, 1.1, 0.1, 1.5, 1.4),  # crowded
        (9.0, 10.0, -0.1, -0.01, 1.1, 0.1, 0.0, 0.0),
    ]
    df = table(spark, rows, names, ("double " * 8).strip())
    out = SG.oi_confirmed_trend(df)
    assert column(out, "signal") == [1, 1, None, None, 0] and column(out, "short_setup") == [False] * 4 + [True]
    assert column(SG.oi_confirmed_trend(df, expansion=False, avoid_funding=False, trend_exit=False), "signal") == [1, 1, 1, 1, None]
    assert column(SG.oi_confirmed_trend(df.drop("oi_change_pct_5"), context=True), "signal") == [1, None, None, None, 0]
    with pytest.raises(ValueError):
        SG.oi_confirmed_trend(df.drop("oi_change_pct_5", "oi_zscore_60"))


def test_regimes_and_tags(spark):
    rows = [(None, 0.1, True, False, False, True, False, False), (0.01, 0.1, False, True, True, True, True, True), (-0.01, 0.1, False, False, False, False, False, True)]
    df = table(spark, rows, "trend_strength_50_200 realized_vol_60 funding_extreme_pos funding_extreme_neg oi_expansion oi_flush perp_premium_extreme perp_discount_extreme", "double double " + ("boolean " * 6).strip())
    out = FT.add_regimes(df)
    assert column(out, "market_regime_tags") == ["range|normal_vol|positive_extreme|flush|neutral", "up|normal_vol|negative_extreme|expansion|premium_extreme", "down|normal_vol|neutral|neutral|discount_extreme"]
    assert column(out, "tag_trend_down") == [False, False, True] and column(out, "tag_oi_flush") == [True, False, False]
    assert column(FT.add_regimes(df.drop("funding_extreme_pos")), "funding_regime") == ["missing"] * 3
    with pytest.raises(ValueError):
        FT.add_regimes(df.drop("oi_flush"), allow_missing=False)
    # volatility against its own quartiles, after 120 values
    vol = table(spark, [(0.0, float(i)) for i in range(130)], "trend_strength_50_200 realized_vol_60", "double double")
    got = column(FT.add_regimes(vol), "volatility_regime")
    assert got[:119] == ["normal_vol"] * 119 and set(got[119:]) == {"high_vol"}


def test_context_filters(spark):
    rows = [(1, 2.5, True, False, True, False), (-1, 2.6, False, True, True, False), (1, None, None, None, None, None), (-1, -1.0, True, False, False, True), (0, 0.0, True, False, False, False)]
    df = table(spark, rows, "signal volatility_zscore trend_up liquidity_stress rsi_high rsi_low", "int double boolean boolean boolean boolean")
    want = {
        "unfiltered_champion": [1, -1, 1, -1, 0], "volatility_extreme_disable": [1, 0, 0, -1, 0], "moderate_volatility_only": [0, 0, 0, -1, 0], "trend_strength_filter": [1, 0, 0, -1, 0],
        "liquidity_stress_disable": [1, 0, 0, -1, 0], "funding_crowding_filter": [0, -1, 1, 0, 0], "simple_combined_filter": [0, 0, 0, 0, 0],
    }
    for kind, signals in want.items():
        assert column(SG.context_filtered(df, kind), "signal") == signals, kind
    kept = SG.retention(df).first()
    assert kept["n_signals"] == 4 and kept["kept_funding_crowding_filter"] == 0.5
    assert SG.retention(df.where("signal = 0")).first()["kept_trend_strength_filter"] == 1.0


def test_crosses(spark):
    closes = [10.0] * 5 + [11.0] * 5 + [9.0] * 5
    df = table(spark, [(c,) for c in closes], "close", "double")
    assert column(SG.macd_cross(df), "signal") == [-1] * 5 + [1] * 5 + [-1] * 5  # a signal on every bar
    assert column(SG.macd_cross(df), "crossed") == [None] * 5 + [1] + [None] * 4 + [-1] + [None] * 4  # and where it crosses
    below = SG.rsi_sma(df, 1, 3, 2, side=101.0, above=False)
    assert column(below, "signal")[5] == 1 and column(SG.rsi_sma(df, 1, 3, 2, side=101.0), "signal")[5] is None


def test_gate_and_attribution(spark):
    m = spark.createDataFrame([("a", 30, 0.5, None, -0.25, 0.0, 0.0), ("b", 0, 0.0, None, -0.26, 0.1, 0.1), ("c", 60, 0.5, 0.9, -0.1, -0.1, -0.1)], "symbol string, trade_count int, win_rate double, profit_factor double, max_drawdown double, smart_sharpe double, cumulative_return double")
    got = {r.symbol: r for r in B.pipeline_gate(m).collect()}
    assert got["a"].gate_passed and got["a"].low_trades  # no loss: the factor is infinite
    assert got["b"].gate_reasons == ["trade_count", "max_drawdown", "profit_factor"] and not got["b"].low_trades
    assert got["c"].gate_reasons == ["profit_factor", "sharpe", "cumulative_return"] and not got["c"].low_trades
    rows = [(0.1, 1.0, 0.0, 0.0), (-0.2, 1.0, 1.0, 0.01), (-0.1, -1.0, 2.0, 0.02)]
    led = table(spark, rows, "net_return position turnover cost_return", ("double " * 4).strip())
    split = "2024-01-01 01:00:00"
    out = {r.is_post: r for r in A.period_attribution(led, split).collect()}
    assert out[False].failure is None and out[True].failure == "market_regime_shift_to_chop" and abs(out[True].cumulative_return - (0.8 * 0.9 - 1)) < 1e-12
    costly = A.period_attribution(led.withColumn("cost_return", F.lit(0.1)), split).where("is_post").first()
    short = A.period_attribution(led.withColumn("position", -F.col("position")), split).where("is_post").first()
    assert costly.failure == "cost_turnover_drag" and short.failure == "short_side_failure"


def test_portfolio_weights(spark):
    rows = [("A", 0, 0.1, 1), ("B", 0, 0.3, 0), ("A", 1, 0.2, 1), ("B", 1, 0.1, 1), ("A", 2, 0.1, None), ("B", 2, 0.5, None)]
    led = spark.createDataFrame([(s, START + dt.timedelta(hours=t), r, g) for s, t, r, g in rows], "symbol string, ts timestamp, net_return double, signal int")
    get = lambda kind: [round(x, 9) for x in column(B.portfolio(led, kind, n=2), "portfolio_return")]
    assert get("equal") == [0.2, 0.15, 0.3] and get("active") == [0.1, 0.15, 0.0]
    a, b = 2**0.5 / 0.1, 2**0.5 / 0.2  # of two returns the deviation is their distance by the root of two
    c, d = 2**0.5 / 0.1, 2**0.5 / 0.4
    assert get("inverse_vol") == [round(x, 9) for x in (0.2, (a * 0.2 + b * 0.1) / (a + b), (c * 0.1 + d * 0.5) / (c + d))]


def test_objective_and_scores(spark):
    m = spark.createDataFrame([("a", 1.0, 2.0, -0.2, -0.1, 3.0, 10, 1.5, 0.5, -0.1, True), ("b", 1.0, None, -0.1, -0.01, 0.5, 40, None, 1.0, 0.2, True)], "symbol string, smart_sharpe double, is_sharpe double, max_drawdown double, max_daily_drawdown double, turnover double, trade_count int, profit_factor double, walk_forward_pass_rate double, cumulative_return double, validation_passed boolean")
    got = {r.symbol: r for r in R.multi_objective(m).collect()}
    assert abs(got["a"].score - (3 + 3 + 1 - (0.04 * 3 + 0.02 * 2 + 2 + 20 + 1 + 2))) < 1e-9
    assert got["a"].failures == ["low_trade_count", "max_drawdown_exceeded", "is_oos_sharpe_gap_too_large", "turnover_too_high", "max_daily_drawdown_exceeded", "oos_return_not_positive"]
    assert got["b"].passed and abs(got["b"].score - 5.0) < 1e-9
    f = spark.createDataFrame([("x", "unfiltered_champion", 1.0, -0.2, 1.0), ("x", "calm", 1.1, -0.1, 0.5), ("x", "few", 1.1, -0.3, 0.1), ("x", "worse", 0.5, -0.3, 0.1)], "symbol string, filter_id string, smart_sharpe double, max_drawdown double, retention double")
    got = {r.filter_id: (r.score, r.classification, r.selected) for r in R.filter_scores(f, synthetic=("few",)).collect()}
    assert got == {"unfiltered_champion": (1, "keep_unfiltered_champion", False), "calm": (3, "accept_filter_candidate", True), "few": (0, "promising_but_needs_real_context_data", False), "worse": (-1, "reject_filter", False)}
    names = "symbol string, run string, smart_sharpe double, max_drawdown double, cumulative_return double"
    runs = spark.createDataFrame([("x", "test", 1.0, -0.1, 0.1), ("x", "hold", 0.5, -0.2, 0.1), ("x", "cost", 0.5, -0.2, -0.1)], names)
    w = spark.createDataFrame([("x", 1.0), ("x", -1.0)], "symbol string, cumulative_return double")
    out = R.robustness(runs, w, w).first()
    assert (out.robustness_score, out.robustness_class) == (4, "promising_but_needs_filters") and "profitable_windows" in out.reasons and "broad_neighbourhood" not in out.reasons


def test_divergence_strength(spark):
    rows = [(10.0, 12.0, -1.0)] * 3 + [(9.0, 12.0, -0.8), (8.0, 12.0, -0.4), (11.0, 13.0, -2.0)]
    out = I.add_divergence(table(spark, rows, "low high macd", "double double double"), n=3)
    assert column(out, "bullish_divergence") == [False] * 4 + [True, False]  # of -1 to -0.8 the strength is a fifth: too weak
    assert [None if x is None else round(x, 9) for x in column(out, "divergence_strength")][4:] == [0.5, round(abs((-0.4 + 2.0) / 0.4), 9)] and column(out, "bearish_divergence")[5]


def test_divergence_of_equal_prices(spark):
    rows = [(10.0, 12.0, -1.0), (10.0, 12.0, -3.0), (11.0, 11.0, -2.0), (9.0, 12.0, -2.0), (9.0, 13.0, -2.5)]
    df = table(spark, rows, "low high macd", "double double double")
    # at the low of 10 MACD was -1, then -3; at the high of 12 it was -3, then -2
    for earliest, found in ((True, False), (False, True)):
        out = I.add_divergence(df, n=3, earliest=earliest)
        assert column(out, "bullish_divergence") == [False] * 3 + [found, False] and column(out, "bearish_divergence") == [False] * 4 + [found]


def test_price_columns(spark):
    df = spark.createDataFrame([("20240102", "03:04:05", 10.0, 2.0), ("20240102", "03:04:06", None, 2.0)], "Date string, Time string, close double, Spread double")
    assert [(r.ts, r.bid, r.ask) for r in M.detect_prices(df).collect()] == [(dt.datetime(2024, 1, 2, 3, 4, 5), 10.0, 12.0)]
    assert M.detect_prices(df, year=2023).count() == 0
    both = spark.createDataFrame([(1.7e12, 5, 1.0)], "open_time double, ts int, Close double")
    assert [(r.ts.year, r.bid, r.ask) for r in M.detect_prices(both).collect()] == [(2023, 1.0, 1.0)]
    with pytest.raises(ValueError):
        M.detect_prices(spark.createDataFrame([(1.0,)], "close double"))
