"""Registered queries on windows, features, signals, ledgers, research and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import indicators as I
from .functions import text as T1
from .functions.columns import before, by_time, deviation, forward_fill, percentile_rank, quantile, rolling, zscore
from .operators import scan
from .plans import features as FT
from .plans import ledger as B
from .plans import metrics as A
from .plans import research as R
from .plans import signals as SG
from .queries import GATED, MET, RSI_LEDGER, RSI_SHORT, gate_inputs, query, rsi_ledger, tidy
from .sources import market as M
from .sources.store import scratch

KT = "symbol, ts"


def _close():
    return F.col("close")


# windows
@query(f"WITH {S.BARS} SELECT {KT}, {S.r(*(S.ret('close', n) + f' AS ret_{n}' for n in (1, 5, 15, 60)), 'ln(' + S.div('close', S.lag('close')) + ') AS log_ret_1', 'abs(' + S.ret() + ') AS abs_ret_1')} FROM bars")
def window_returns(spark, d):
    """W1-W3."""
    out = I.add_returns(M.bars(spark, d))
    return tidy(out.select("symbol", "ts", "ret_1", "ret_5", "ret_15", "ret_60", "log_ret_1", "abs_ret_1"))


_ROLL = f"""WITH {S.BARS}, b AS (SELECT *, {S.ret()} AS ret FROM bars) SELECT {KT}, {S.r(
    S.roll('avg', 'close', 10) + ' AS sma_10', S.roll('max', 'high', 20) + ' AS high_20', S.roll('min', 'low', 20) + ' AS low_20', S.dev('ret', 20) + ' AS vol_20', S.z('close', 30) + ' AS z_30',
    f"CASE WHEN count(close) OVER {S.frame(30)} >= 30 THEN len(list_filter(list(close) OVER {S.frame(30)}, lambda v: v <= close)) / 30.0 END AS rank_30", S.quantile('close', 0.9, 90, 30) + ' AS q90')} FROM b"""


@query(_ROLL)
def window_rolling(spark, d):
    """W4-W9."""
    b = M.bars(spark, d).withColumn("ret", I.returns(_close()))
    return tidy(b.select("symbol", "ts", rolling(F.avg, _close(), 10).alias("sma_10"), rolling(F.max, F.col("high"), 20).alias("high_20"), rolling(F.min, F.col("low"), 20).alias("low_20"), deviation(F.col("ret"), 20).alias("vol_20"), zscore(_close(), 30).alias("z_30"), percentile_rank(_close(), 30).alias("rank_30"), quantile(_close(), 0.9, 90, least=30).alias("q90")))


_BANDS = f"""{S.BARS}, b0 AS (SELECT *, {S.roll('avg', 'close', 20)} AS mid, {S.dev('close', 20, 'stddev_pop')} AS sd FROM bars),
bands AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS low_b FROM b0),
reclaim AS (SELECT *, low < low_b AND close > low_b AS bb_reclaim_lower, high > up AND close < up AS bb_reclaim_upper, {S.lag('close')} < {S.lag('low_b')} AND close > low_b AS bb_reclaim_lower_strict, {S.lag('close')} > {S.lag('up')} AND close < up AS bb_reclaim_upper_strict FROM bands)"""


@query(f"WITH {_BANDS} SELECT {KT}, {S.r('mid AS bb_mid_20', 'up AS bb_upper_20', 'low_b AS bb_lower_20', S.div('up - low_b', 'mid') + ' AS bb_width_20', S.div('close - low_b', 'up - low_b') + ' AS bb_pos_20')}, bb_reclaim_lower, bb_reclaim_upper, bb_reclaim_lower_strict, bb_reclaim_upper_strict FROM reclaim")
def window_bands(spark, d):
    """W10, W11."""
    out = I.add_reclaims(I.add_bands(M.bars(spark, d)))
    return tidy(out.drop("open", "high", "low", "close", "volume", "turnover"))


@query(f"WITH {S.BARS}, {S.rsi(14, 'a')}, {S.rsi(14, 'b', flat=100.0)} SELECT a.symbol, a.ts, round(a.rsi, 6) AS rsi_14, round(b.rsi, 6) AS rsi_indicator FROM a JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def window_rsi(spark, d):
    """Both variants."""
    out = I.add_rsi(I.add_rsi(M.bars(spark, d)), flat=100.0, name="rsi_indicator")
    return tidy(out.select("symbol", "ts", "rsi_14", "rsi_indicator"))


_EMA = f"WITH RECURSIVE {S.BARS}, {S.recursion()}"


_SPANS = (10, 20, 50, 200)
_MEANS = ", ".join(f"CASE WHEN num.n >= {n} THEN y{n} END AS ema_{n}" for n in _SPANS)


@query(f"{_EMA}, e AS (SELECT num.*, {_MEANS} FROM num JOIN rec USING (symbol, n)) SELECT {KT}, {S.r(*(f'ema_{n}' for n in _SPANS), *(f'close / ema_{n} - 1 AS ema_dist_{n}' for n in _SPANS), 'ema_50 / ema_200 - 1 AS trend_strength_50_200')} FROM e")
def window_ema_scan(spark, d):
    """W13, W14 by the block scan."""
    out = scan.add_trend(M.bars(spark, d))
    return tidy(out.select("symbol", "ts", *(f"ema_{n}" for n in _SPANS), *(f"ema_dist_{n}" for n in _SPANS), "trend_strength_50_200"))


@query(f"{_EMA} SELECT rec.symbol, rec.ts, {S.r('y12 - y26 AS macd', 'sig AS macd_signal', 'y12 - y26 - sig AS macd_hist')} FROM rec")
def window_macd(spark, d):
    """W15."""
    return tidy(scan.add_macd(M.bars(spark, d)).select("symbol", "ts", "macd", "macd_signal", "macd_hist"))


_WILDER = f"""WITH RECURSIVE {S.BARS}, c AS (SELECT *, row_number() OVER {S.P} AS n, greatest(coalesce(close - {S.lag('close')}, 0), 0) AS up_, greatest(coalesce({S.lag('close')} - close, 0), 0) AS dn_ FROM bars),
seed AS (SELECT symbol, avg(up_) AS u, avg(dn_) AS v FROM c WHERE n BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
w AS (SELECT symbol, CAST(15 AS BIGINT) AS n, u, v FROM seed UNION ALL SELECT c.symbol, c.n, (w.u * 13 + c.up_) / 14 AS u, (w.v * 13 + c.dn_) / 14 AS v FROM w JOIN c ON c.symbol = w.symbol AND c.n = w.n + 1)
SELECT c.symbol, c.ts, round(CASE WHEN w.v < 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + w.u / w.v) END, 6) AS wilder_rsi FROM c LEFT JOIN w USING (symbol, n)"""


@query(_WILDER)
def window_wilder_rsi(spark, d):
    """ST3's batch twin."""
    return tidy(scan.add_wilder_rsi(M.bars(spark, d)).select("symbol", "ts", "wilder_rsi"))


@query(f"WITH {S.BARS} SELECT {KT}, {S.r(f'max(close) OVER {S.UP_TO} AS peak', f'close / max(close) OVER {S.UP_TO} - 1 AS drawdown')} FROM bars")
def window_drawdown(spark, d):
    """W16."""
    return tidy(I.add_drawdown(M.bars(spark, d)).select("symbol", "ts", "peak", "drawdown"))


@query(f"WITH {S.BARS}, h AS (SELECT *, row_number() OVER {S.P} AS n, close / first(close) OVER {S.P} AS hold FROM bars), k AS (SELECT *, max(hold) OVER {S.UP_TO} AS peak FROM h) SELECT {KT}, {S.r('hold', 'hold / peak - 1 AS drawdown')} FROM k WHERE (n - 1) % 10 = 0")
def window_downsample(spark, d):
    """W31."""
    return tidy(I.downsample(M.bars(spark, d), 10).select("symbol", "ts", "hold", "drawdown"))


_TR = f"{S.BARS}, t AS (SELECT *, greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')})) AS tr FROM bars)"


@query(f"WITH {_TR}, u AS (SELECT *, {S.roll('avg', 'tr', 14)} AS atr FROM t) SELECT {KT}, {S.r('tr AS true_range', 'atr AS atr_14', 'atr / close AS atr_pct_14', '(high - low) / close AS range_pct')} FROM u")
def window_true_range(spark, d):
    """W17."""
    return tidy(I.add_true_range(M.bars(spark, d)).select("symbol", "ts", "true_range", "atr_14", "atr_pct_14", "range_pct"))


_MOMENTUM = S.r("m AS momentum_10", "m20 AS momentum_20", f"m - {S.lag('m', 10)} AS momentum_slope_10", f"close / ({S.roll('avg', 'close', 20)}) - 1 AS price_extension_20")


@query(f"WITH {S.BARS}, m AS (SELECT *, {S.ret('close', 10)} AS m, {S.ret('close', 20)} AS m20 FROM bars) SELECT {KT}, {_MOMENTUM} FROM m")
def window_momentum(spark, d):
    """W18."""
    return tidy(I.add_momentum(M.bars(spark, d)).select("symbol", "ts", "momentum_10", "momentum_20", "momentum_slope_10", "price_extension_20"))


_VOLUME = "volume_zscore_20", "volume_zscore_60", "turnover_zscore_20"


@query(f"WITH {S.BARS}, v AS (SELECT *, {S.z('volume', 20)} AS volume_zscore_20, {S.z('volume', 60)} AS volume_zscore_60, {S.z('turnover', 20)} AS turnover_zscore_20 FROM bars) SELECT {KT}, {S.r(*_VOLUME)}, volume_zscore_20 > 2 AS volume_spike_20, coalesce(abs(volume_zscore_20) >= 1.5, FALSE) AS extreme FROM v")
def window_volume(spark, d):
    """W19, W29."""
    out = I.add_volume(M.bars(spark, d))
    return tidy(out.select("symbol", "ts", *_VOLUME, "volume_spike_20", I.extreme(F.col("volume_zscore_20"), 1.5).alias("extreme")))


@query(f"WITH {S.BARS}, s AS (SELECT *, CASE WHEN volume > 4 THEN close END AS x FROM bars) SELECT {KT}, {S.r(f'last_value(x IGNORE NULLS) OVER {S.UP_TO} AS filled')} FROM s")
def window_forward_fill(spark, d):
    """W20."""
    b = M.bars(spark, d).withColumn("x", F.when(F.col("volume") > 4, _close()))
    return tidy(b.select("symbol", "ts", forward_fill(F.col("x")).alias("filled")))


_EFF = f"{S.BARS}, s AS (SELECT *, abs(close - {S.lag('close')}) AS step, {S.ret()} AS ret FROM bars), t AS (SELECT *, {S.roll('sum', 'step', 14)} AS path, {S.dev('ret', 42)} AS vol FROM s), eff AS (SELECT *, abs(close - {S.lag('close', 14)}) / nullif(path, 0) AS efficiency_ratio, {S.z('vol', 42)} AS vol_z FROM t)"


@query(f"WITH {_EFF} SELECT {KT}, {S.r('efficiency_ratio', 'vol_z')} FROM eff")
def window_efficiency(spark, d):
    """W22."""
    return tidy(I.add_efficiency(M.bars(spark, d)).select("symbol", "ts", "efficiency_ratio", "vol_z"))


_CTX = f"{S.BARS}, {S.rsi(14, 'rs')}, s AS (SELECT *, coalesce({S.ret()}, 0) AS ret FROM rs), v AS (SELECT *, {S.dev('ret', 20)} AS realised_vol FROM s), cx AS (SELECT *, {S.dev('realised_vol', 100)} AS vol_of_vol, {S.z('realised_vol', 100)} AS volatility_zscore, ({S.roll('avg', 'close', 20)}) > ({S.roll('avg', 'close', 50)}) AS trend_up, rsi > 80 AS rsi_high, rsi < 20 AS rsi_low FROM v)"


@query(f"WITH {_CTX} SELECT {KT}, {S.r('realised_vol', 'vol_of_vol', 'volatility_zscore')}, volatility_zscore > 3 AS liquidity_stress, trend_up, rsi_high, rsi_low FROM cx")
def window_context(spark, d):
    """W23."""
    return tidy(I.add_context(I.add_rsi(M.bars(spark, d))).select("symbol", "ts", "realised_vol", "vol_of_vol", "volatility_zscore", "liquidity_stress", "trend_up", "rsi_high", "rsi_low"))


_TD = "CAST(CASE WHEN n > {0} + {1} AND count(*) FILTER (u) OVER {2} = {0} THEN 1 WHEN n > {0} + {1} AND count(*) FILTER (o) OVER {2} = {0} THEN -1 ELSE 0 END AS BIGINT) AS td_setup"


def _td(length: int, lag: int) -> str:
    return f"WITH {S.BARS}, s AS (SELECT *, close < {S.lag('close', lag)} AS u, close > {S.lag('close', lag)} AS o, row_number() OVER {S.P} AS n FROM bars) SELECT {KT}, {_TD.format(length, lag, S.frame(length))} FROM s"


@query(_td(9, 4))
def window_td_setup(spark, d):
    """W24."""
    return tidy(I.add_td_setup(M.bars(spark, d)).select("symbol", "ts", "td_setup"))


@query(_td(4, 2))
def window_td_setup_blocks(spark, d):
    """W24 block by block with a halo, four in a row against two bars before, so that there are some."""
    return tidy(scan.td_setup_in_blocks(M.bars(spark, d), 4, 2, length=128).select("symbol", "ts", "td_setup"))


_UPTO = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_F = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
_PAST, _AHEAD, _FULL = _F.format(6, 4), "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(f"WITH {S.BARS}, e AS (SELECT *, {S.lag('close', 3)} AS c3, count(close) {_FULL} = 7 AS f, max(close) {_PAST} AS pm, max(close) {_AHEAD} AS am, min(close) {_PAST} AS pn, min(close) {_AHEAD} AS an FROM bars) SELECT {KT}, coalesce(f AND c3 >= pm AND c3 >= am, FALSE) AS is_high, coalesce(f AND c3 <= pn AND c3 <= an, FALSE) AS is_low, round(CASE WHEN f THEN c3 END, 6) AS extremum FROM e")
def window_extrema(spark, d):
    """W25."""
    return tidy(I.add_extrema(M.bars(spark, d)).select("symbol", "ts", "is_high", "is_low", "extremum"))


_PRE = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    f"""{_EMA}, m AS (SELECT num.*, round(y12 - y26, 9) AS macd FROM num JOIN rec USING (symbol, n)), v AS (SELECT *, count(macd) {_PRE} AS k, min(low) {_PRE} AS pl, max(high) {_PRE} AS ph, arg_min(macd, low) {_PRE} AS ml, arg_max(macd, high) {_PRE} AS mh FROM m),
w AS (SELECT *, coalesce(abs((macd - ml) / nullif(abs(ml), 0)), 0.0) AS bs, coalesce(abs((mh - macd) / nullif(abs(mh), 0)), 0.0) AS rs FROM v), x AS (SELECT *, k = 20 AND coalesce(low < pl AND macd > ml AND bs >= 0.25, FALSE) AS bull, k = 20 AND coalesce(high > ph AND macd < mh AND rs >= 0.25, FALSE) AS bear FROM w)
SELECT {KT}, bull AS bullish_divergence, bear AS bearish_divergence, round(CASE WHEN bull THEN bs WHEN bear THEN rs END, 6) AS divergence_strength FROM x"""
)
def window_divergence(spark, d):
    """W26."""
    b = scan.add_macd(M.bars(spark, d)).withColumn("macd", F.round("macd", 9))
    return tidy(I.add_divergence(b, earliest=True).select("symbol", "ts", "bullish_divergence", "bearish_divergence", "divergence_strength"))


_TRADES = f"{RSI_LEDGER}, {S.trades()}"


_RANGE = f"ranges AS (SELECT symbol, ts, greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')})) AS tr FROM bars), atrs AS (SELECT symbol, ts, {S.roll('avg', 'tr', 14)} AS atr FROM ranges)"


@query(f"WITH {_TRADES}, {_RANGE}, s AS (SELECT trades_r.*, max(greatest(high - 2 * atr, high * 0.95)) OVER (PARTITION BY symbol, trade_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM trades_r JOIN atrs USING (symbol, ts) WHERE trade_id IS NOT NULL) SELECT {KT}, CAST(trade_id AS BIGINT) AS trade_id, round(stop, 6) AS stop, coalesce(low <= lag(stop) OVER (PARTITION BY symbol, trade_id ORDER BY ts), FALSE) AS stopped FROM s")
def window_trailing_stop(spark, d):
    """W27."""
    t = B.add_trades(I.add_true_range(rsi_ledger(spark, d))).where("trade_id IS NOT NULL")
    return tidy(I.add_trailing_stop(t, F.col("atr_14")).select("symbol", "ts", "trade_id", "stop", "stopped"))


@query(f"WITH {S.BARS}, s AS (SELECT *, coalesce({S.ret()} < -0.5, FALSE) AS loss FROM bars) SELECT {KT}, coalesce(max(CAST(loss AS INT)) {_UPTO.format(2)}, 0) = 0 AS ok FROM s")
def window_cooldown(spark, d):
    """W28."""
    b = M.bars(spark, d).withColumn("loss", F.coalesce(I.returns(_close()) < -0.5, F.lit(False)))
    return tidy(b.select("symbol", "ts", I.cooled(F.col("loss"), 3).alias("ok")))


@query(f"WITH {RSI_LEDGER} SELECT symbol, count(*) AS n_bars, CAST(0 AS BIGINT) AS lag_violations FROM ledger GROUP BY symbol")
def window_lag_check(spark, d):
    """W30."""
    return tidy(R.lag_violations(rsi_ledger(spark, d)))


@query(f"WITH {S.BARS} SELECT {KT}, {S.r(S.roll('avg', 'close', 20) + ' AS sma_20', S.z('close', 30) + ' AS z_30')} FROM bars")
def window_halo_blocks(spark, d):
    """Rolling columns block by block with a halo of 30 rows; the rows are those of plain windows."""

    def add(df: DataFrame, keys) -> DataFrame:
        return df.withColumns({"sma_20": rolling(F.avg, _close(), 20, keys), "z_30": zscore(_close(), 30, keys)})

    return tidy(scan.with_halo(M.bars(spark, d), add, 30, length=128).select("symbol", "ts", "sma_20", "z_30"))


# features
_FUND = f"""{S.MARKET}, f1 AS (SELECT *, {S.z('funding_rate', 30)} AS fz, {S.quantile('funding_rate', 0.9, 90, 30)} AS fq, open_interest / nullif({S.lag('open_interest', 5)}, 0) - 1 AS p, {S.z('open_interest', 60)} AS oz, {S.z('basis', 60)} AS bz, {S.quantile('basis', 0.9, 90, 30)} AS bq FROM market)"""


@query(
    f"""WITH {_FUND} SELECT {KT}, {S.r('fz AS funding_zscore_30', 'open_interest - ' + S.lag('open_interest') + ' AS oi_diff_1', 'open_interest - ' + S.lag('open_interest', 5) + ' AS oi_diff_5', 'p AS oi_change_pct_5', 'oz AS oi_zscore_60', 'bz AS basis_zscore_60')},
coalesce(funding_rate >= fq, FALSE) AS funding_high_q90, coalesce(fz > 2, FALSE) AS funding_extreme_pos, coalesce(fz < -2, FALSE) AS funding_extreme_neg, coalesce(abs({S.lag('fz')}) > 2 AND abs(fz) < 0.5, FALSE) AS funding_reset, coalesce(oz > 2 OR p > 0.03, FALSE) AS oi_expansion, coalesce(oz < -2 OR p < -0.03, FALSE) AS oi_flush, coalesce(basis >= bq, FALSE) AS basis_high_q90, coalesce(bz > 2, FALSE) AS perp_premium_extreme, coalesce(bz < -2, FALSE) AS perp_discount_extreme FROM f1"""
)
def features_derivatives(spark, d):
    """F1-F4, W21."""
    m = M.market(spark, d)
    out = FT.add_derivatives(m)
    return tidy(out.select("symbol", "ts", *[c for c in out.columns if c not in m.columns]))


_MEMA = f"WITH RECURSIVE {_FUND}, {S.recursion('f1')}, t AS (SELECT num.*, {_MEANS} FROM num JOIN rec USING (symbol, n))"
_REG = f"""{_MEMA}, g1 AS (SELECT *, {S.ret()} AS r1 FROM t), g2 AS (SELECT *, {S.dev('r1', 60)} AS rv FROM g1), g3 AS (SELECT *, {S.quantile('rv', 0.25, 240, 120)} AS lo, {S.quantile('rv', 0.75, 240, 120)} AS hi, ema_50 / ema_200 - 1 AS strength FROM g2),
rg AS (SELECT symbol, ts, CASE WHEN strength > 0 THEN 'up' WHEN strength < 0 THEN 'down' ELSE 'range' END AS trend_regime, CASE WHEN rv > hi THEN 'high_vol' WHEN rv < lo THEN 'low_vol' ELSE 'normal_vol' END AS volatility_regime,
  CASE WHEN fz > 2 THEN 'positive_extreme' WHEN fz < -2 THEN 'negative_extreme' ELSE 'neutral' END AS funding_regime, CASE WHEN oz > 2 OR p > 0.03 THEN 'expansion' WHEN oz < -2 OR p < -0.03 THEN 'flush' ELSE 'neutral' END AS oi_regime,
  CASE WHEN bz > 2 THEN 'premium_extreme' WHEN bz < -2 THEN 'discount_extreme' ELSE 'neutral' END AS basis_regime FROM g3)"""
_REGIMES = ("trend_regime", "volatility_regime", "funding_regime", "oi_regime", "basis_regime")


@query(f"{_REG} SELECT *, {', '.join(f'{regime} = {chr(39)}{value}{chr(39)} AS {tag}' for tag, regime, value in FT.TAGS)}, {' || chr(124) || '.join(_REGIMES)} AS market_regime_tags FROM rg")
def features_regimes(spark, d):
    """F5, F6."""
    out = FT.feature_dataset(M.market(spark, d), stages=("returns", "volatility", "trend", "derivatives", "regimes"))
    return tidy(out.select("symbol", "ts", *_REGIMES, *(tag for tag, _, _ in FT.TAGS), "market_regime_tags"))


@query()
def feature_pipeline(spark, d):
    """All stages on the market dataset; its stages are compared one by one above."""
    m = M.market(spark, d)
    out = FT.feature_dataset(m)
    return tidy(out.select("symbol", "ts", *FT.feature_columns(out, m.columns)))


@query(f"WITH {S.MARKET} SELECT symbol, count(*) FILTER (funding_rate IS NOT NULL AND funding_available_at > available_at) AS n_late_funding_rate, count(*) FILTER (open_interest IS NOT NULL AND oi_available_at > available_at) AS n_late_open_interest, CAST(0 AS BIGINT) AS n_late_basis FROM market GROUP BY symbol")
def feature_causality(spark, d):
    """A13."""
    return FT.causality_report(M.market(spark, d))


@query(f"WITH {S.MARKET}, q AS (SELECT *, {S.z('funding_rate', 30)} AS fz, row_number() OVER {S.P} AS n FROM market) SELECT symbol, count(*) AS n_rows, count(*) FILTER (fz IS NULL) AS nulls_fz, count(*) FILTER (basis IS NULL) AS nulls_basis, round(avg(CASE WHEN n > 120 THEN CASE WHEN fz IS NOT NULL THEN 1.0 ELSE 0.0 END END), 6) AS coverage_fz, round(avg(CASE WHEN n > 120 THEN CASE WHEN basis IS NOT NULL THEN 1.0 ELSE 0.0 END END), 6) AS coverage_basis FROM q GROUP BY symbol")
def feature_quality(spark, d):
    """A10, A14, F9."""
    m = M.market(spark, d).withColumn("fz", zscore(F.col("funding_rate"), 30))
    return tidy(FT.quality_report(m, ["fz", "basis"]))


# signals
_SIG = "CAST({} AS BIGINT) AS signal"


@query(f"WITH {_BANDS}, g AS (SELECT *, {S.roll('avg', 'close', 50)} AS regime_sma FROM bands) SELECT {KT}, {_SIG.format('CASE WHEN close > up AND close > regime_sma THEN 1 WHEN close < mid THEN 0 END')} FROM g")
def signal_bb_breakout(spark, d):
    """S1."""
    return tidy(SG.STRATEGIES.signals("BB-Breakout", M.bars(spark, d)).select("symbol", "ts", "signal"))


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs')}, a AS (SELECT *, {S.roll('avg', 'close', 10)} AS f, {S.roll('avg', 'close', 30)} AS s FROM rs), b AS (SELECT *, f > s AND {S.lag('f')} <= {S.lag('s')} AS up, f < s AND {S.lag('f')} >= {S.lag('s')} AS dn FROM a) SELECT {KT}, {_SIG.format('CASE WHEN up AND rsi > 50 THEN 1 WHEN dn THEN 0 END')} FROM b")
def signal_rsi_sma(spark, d):
    """S2."""
    return tidy(SG.rsi_sma(M.bars(spark, d)).select("symbol", "ts", "signal"))


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs')}, a AS (SELECT *, {S.roll('avg', 'close', 10)} AS f, {S.roll('avg', 'close', 30)} AS s FROM rs), b AS (SELECT *, f > s AND {S.lag('f')} <= {S.lag('s')} AS up, f < s AND {S.lag('f')} >= {S.lag('s')} AS dn FROM a) SELECT {KT}, {_SIG.format('CASE WHEN up AND rsi < 60 THEN 1 WHEN dn THEN 0 END')} FROM b")
def signal_rsi_sma_below(spark, d):
    """S2 with the RSI under a limit."""
    return tidy(SG.rsi_sma(M.bars(spark, d), side=60.0, above=False).select("symbol", "ts", "signal"))


_H = S.held
_VARIANTS = {
    "neutral-exit": S.neutral(), "extreme-zone": "CASE WHEN rsi >= 70 THEN 1 WHEN rsi <= 30 THEN -1 ELSE 0 END", "always-in": _H("CASE WHEN rsi >= 70 THEN 1 WHEN rsi <= 30 THEN -1 END"),
    "mean-reversion": f"({_H('CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 50 THEN 0 END')} + {_H('CASE WHEN rsi >= 70 THEN -1 WHEN rsi <= 50 THEN 0 END')})", "long-flat": _H("CASE WHEN rsi >= 70 THEN 1 WHEN rsi < 50 THEN 0 END"), "buy-and-hold": "1", "flat": "0",
}


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs', flat=100.0)} SELECT {KT}, {', '.join(f'CAST({x} AS BIGINT) AS ' + n.replace('-', '_') for n, x in _VARIANTS.items())} FROM rs")
def signal_rsi_variants(spark, d):
    """S3: the seven variants side by side."""
    b = I.add_rsi(M.bars(spark, d), 14, flat=100.0, name="rsi")
    return tidy(b.select("symbol", "ts", *(SG.rsi_signal(v, F.col("rsi"), SG.RsiParams()).alias(v.replace("-", "_")) for v in SG.RSI_VARIANTS)))


_SQUEEZE = f"{S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, q1 AS (SELECT *, 4 * ({S.dev('close', 20)}) / nullif({S.roll('avg', 'close', 20)}, 0) AS w FROM rs), q2 AS (SELECT *, coalesce(w <= {S.quantile('w', 0.25, 125)}, FALSE) AS squeeze FROM q1)"


@query(f"WITH {_SQUEEZE} SELECT {KT}, squeeze, CAST({_H('CASE WHEN rsi >= 70 AND squeeze THEN 1 WHEN rsi < 50 THEN 0 END')} + {_H('CASE WHEN rsi <= 30 AND squeeze THEN -1 WHEN rsi > 50 THEN 0 END')} AS BIGINT) AS signal FROM q2")
def signal_rsi_squeeze(spark, d):
    """S4."""
    return tidy(SG.rsi_momentum(M.bars(spark, d), SG.RsiParams(squeeze_only=True)).select("symbol", "ts", "squeeze", "signal"))


_ENS = f"""{S.BARS}, {S.rsi(14, 'e14', flat=100.0)}, e14b AS (SELECT * RENAME (rsi AS r14) FROM e14), {S.rsi(21, 'e21', 'e14b', flat=100.0)}, e21b AS (SELECT * RENAME (rsi AS r21) FROM e21), {S.rsi(7, 'e7', 'e21b', flat=100.0)}, e7b AS (SELECT * RENAME (rsi AS r7) FROM e7),
v AS (SELECT *, {S.neutral().replace('rsi', 'r14')} + {S.neutral('75', '25', '55').replace('rsi', 'r14')} + {S.neutral().replace('rsi', 'r21')} + {S.neutral('75', '25', '50').replace('rsi', 'r7')} AS votes, abs({S.ret()}) AS a FROM e7b),
ens AS (SELECT *, round_even(votes / 4.0, 0) AS e, least(greatest(coalesce(0.02 / nullif({S.roll('avg', 'a', 20)}, 0), 1.0), 0.25), 1.0) AS vol_scale FROM v)"""


@query(f"WITH {_ENS} SELECT {KT}, CAST(e AS BIGINT) AS ensemble_signal, {S.r('vol_scale', 'e * vol_scale AS signal')} FROM ens")
def signal_ensemble(spark, d):
    """S5."""
    return tidy(SG.ensemble(M.bars(spark, d)).select("symbol", "ts", "ensemble_signal", "vol_scale", "signal"))


def market_features(spark, d) -> DataFrame:
    """The market dataset with all that the derivative strategies use."""
    return FT.feature_dataset(M.market(spark, d), stages=("returns", "trend", "bands", "momentum", "volume", "derivatives", "forced_flow"))


_MB = _BANDS.replace(S.BARS + ", ", "").replace("FROM bars", "FROM f1")
_MF = f"""{_FUND}, {_MB}, {S.rsi(14, 'mr', 'reclaim')}, m1 AS (SELECT *, {S.ret('close', 10)} AS m10, {S.z('close', 20)} AS ext, {S.ret()} AS r1, {S.z('volume', 30)} AS vz FROM mr), mf AS (SELECT *, m10 - {S.lag('m10', 5)} AS slope FROM m1)"""
_FLOW = f"z AS (SELECT *, {S.z('r1', 60)} AS rz, {S.z('volume', 20)} AS v20, coalesce(oz < -2 OR p < -0.03, FALSE) AS fl FROM mf), fw AS (SELECT *, rz < -0.5 AS falls, rz > 0.5 AS rises, v20 > 0.5 AS busy FROM z), fx AS (SELECT *, falls AND busy AND fl AS sold, rises AND busy AND fl AS bought FROM fw)"


@query(f"WITH {_MF}, {_FLOW} SELECT {KT}, falls AS return_shock_down, rises AS return_shock_up, busy AS volume_shock, fl AS oi_flush_event, sold AS forced_selling_proxy, bought AS forced_buying_proxy, sold AND coalesce(bb_reclaim_lower, FALSE) AS liquidation_proxy_long, bought AND coalesce(bb_reclaim_upper, FALSE) AS liquidation_proxy_short FROM fx")
def features_forced_flow(spark, d):
    """F7, with lower thresholds, so that there are some."""
    out = FT.add_forced_flow(market_features(spark, d), 0.5, 0.5)
    return tidy(out.select("symbol", "ts", "return_shock_down", "return_shock_up", "volume_shock", "oi_flush_event", "forced_selling_proxy", "forced_buying_proxy", "liquidation_proxy_long", "liquidation_proxy_short"))



@query(f"WITH {_MF}, s AS (SELECT *, coalesce(bb_reclaim_lower AND coalesce(r1 <= -0.02 AND vz >= 0, FALSE) AND fz <= 1, FALSE) AS long_setup, coalesce(close >= mid, FALSE) AS exit_signal FROM mf) SELECT {KT}, long_setup, exit_signal, {_SIG.format('CASE WHEN long_setup THEN 1 WHEN exit_signal THEN 0 END')} FROM s")
def signal_forced_flow(spark, d):
    """S6, with the funding filter at 1 and a weaker volume shock, so that there are entries."""
    f = market_features(spark, d).withColumns({"forced_selling_proxy": (F.col("ret_1") <= -0.02) & (F.col("volume_z") >= 0), "funding_zscore_30": F.col("funding_zscore_30") - 1}).drop("liquidation_proxy_long")
    return tidy(SG.forced_flow_band_reclaim(f).select("symbol", "ts", "long_setup", "exit_signal", "signal"))


_TURN = f"x1 AS (SELECT *, m10 - {S.lag('m10', 10)} AS turn, close / ({S.roll('avg', 'close', 20)}) - 1 AS stretch FROM mf)"


@query(f"WITH {_MF}, {_TURN}, s AS (SELECT *, coalesce(rsi <= 48 AND fz <= -0.2 AND stretch <= -0.002 AND turn > 0, FALSE) AS long_setup, coalesce(rsi >= 52 AND fz >= 0.2 AND turn < 0, FALSE) AS short_setup, coalesce(rsi >= 50, FALSE) AS exit_signal FROM x1) SELECT {KT}, long_setup, short_setup, {_SIG.format('CASE WHEN long_setup THEN 1 WHEN exit_signal THEN 0 END')} FROM s")
def signal_funding_reversal(spark, d):
    """S7 at thresholds that occur."""
    out = SG.funding_exhaustion_reversal(market_features(spark, d), oversold=48, overbought=52, funding=0.2, extension=0.002)
    return tidy(out.select("symbol", "ts", "long_setup", "short_setup", "signal"))


@query(f"WITH {_MF}, {_TURN}, s AS (SELECT *, coalesce(rsi <= 48 AND bz <= -0.1 AND {S.ret('close', 60)} <= 0, FALSE) AS long_setup, coalesce(rsi >= 52 AND fz >= 0.2 AND turn < 0, FALSE) AS short_setup FROM x1) SELECT {KT}, long_setup, short_setup, {_SIG.format('CASE WHEN long_setup THEN 1 END')} FROM s")
def signal_funding_reversal_by_basis(spark, d):
    """S7 without context or turn, extended by the return of 60 bars, confirmed by the basis, with no exit."""
    df = market_features(spark, d).drop("price_extension_20")
    out = SG.funding_exhaustion_reversal(df, oversold=48, overbought=52, mid_exit=False, funding=0.2, extension=0.0, turn=False, basis=True, basis_limit=0.1, context=False)
    return tidy(out.select("symbol", "ts", "long_setup", "short_setup", "signal"))


@query(f"{_MEMA}, s AS (SELECT *, coalesce(ema_50 / ema_200 - 1 > 0 AND close / ema_20 - 1 > 0 AND close > ema_20 AND (oz > 1 OR p > 0) AND fz < 1.5 AND bz < 1.5, FALSE) AS long_setup, coalesce(ema_50 / ema_200 - 1 < 0 AND close < ema_20 AND (oz > 1 OR p > 0), FALSE) AS short_setup, coalesce(close < ema_20, FALSE) AS exit_signal FROM t) SELECT {KT}, long_setup, short_setup, {_SIG.format('CASE WHEN long_setup THEN 1 WHEN exit_signal THEN 0 END')} FROM s")
def signal_oi_trend(spark, d):
    """S8."""
    return tidy(SG.oi_confirmed_trend(market_features(spark, d)).select("symbol", "ts", "long_setup", "short_setup", "signal"))


@query(f"{_MEMA}, s AS (SELECT *, coalesce(ema_50 / ema_200 - 1 > -0.05 AND close / ema_20 - 1 > 0.001 AND close > ema_20 AND oz > 0.5 AND bz < 1, FALSE) AS long_setup, coalesce(ema_50 / ema_200 - 1 < 0.05 AND close < ema_20 AND oz > 0.5, FALSE) AS short_setup FROM t) SELECT {KT}, long_setup, short_setup, {_SIG.format('CASE WHEN long_setup THEN 1 END')} FROM s")
def signal_oi_trend_by_zscore(spark, d):
    """S8 by the z-score alone, whatever the funding, with no exit."""
    out = SG.oi_confirmed_trend(market_features(spark, d).drop("oi_change_pct_5"), strength=-0.05, distance=0.001, oi=0.5, avoid_funding=False, crowded_basis=1.0, trend_exit=False)
    return tidy(out.select("symbol", "ts", "long_setup", "short_setup", "signal"))


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, s AS (SELECT *, {S.neutral('60', '40')} AS sig FROM rs) SELECT {KT}, CAST(sig * coalesce(CAST(({S.roll('avg', 'close', 20)}) > ({S.roll('avg', 'close', 50)}) AS INT), 0) AS BIGINT) AS signal FROM s")
def signal_trend_filter(spark, d):
    """S9."""
    return tidy(SG.trend_filtered(SG.rsi_momentum(M.bars(spark, d), SG.RsiParams(14, 60, 40, 50))).select("symbol", "ts", "signal"))


_CHOP = f"{_EFF}, {S.rsi(14, 'rs', 'eff', flat=100.0)}, cs AS (SELECT *, {S.neutral('60', '40')} AS sig FROM rs), cl AS (SELECT *, coalesce({S.lag('sig')} * ({S.ret()}) < 0, FALSE) AS loss FROM cs)"


@query(f"WITH {_CHOP} SELECT {KT}, CAST(CASE WHEN coalesce(efficiency_ratio >= 0.3, FALSE) THEN sig ELSE 0 END AS BIGINT) AS efficiency, CAST(CASE WHEN coalesce(vol_z >= -1 AND vol_z <= 2, FALSE) THEN sig ELSE 0 END AS BIGINT) AS moderate_vol, CAST(CASE WHEN coalesce(vol_z <= 2.5, FALSE) THEN sig ELSE 0 END AS BIGINT) AS no_high_vol, CAST(CASE WHEN coalesce(max(CAST(loss AS INT)) {_UPTO.format(11)}, 0) = 0 THEN sig ELSE 0 END AS BIGINT) AS cooldown FROM cl")
def signal_chop_filters(spark, d):
    """S10."""
    base = SG.rsi_momentum(I.add_efficiency(M.bars(spark, d)), SG.RsiParams(14, 60, 40, 50)).withColumn("_raw", F.col("signal"))
    for k in SG.CHOP_FILTERS[1:]:
        base = SG.chop_filtered(base.withColumn("signal", F.col("_raw")), k).withColumnRenamed("signal", k)
    return tidy(base.select("symbol", "ts", *SG.CHOP_FILTERS[1:]))


_CROWD = "(sig > 0 AND rsi_high OR sig < 0 AND rsi_low)"
_CF = {
    "unfiltered_champion": "TRUE", "volatility_extreme_disable": "volatility_zscore <= 2.5", "moderate_volatility_only": "volatility_zscore BETWEEN -1 AND 2", "trend_strength_filter": "trend_up",
    "liquidity_stress_disable": "NOT volatility_zscore > 3", "funding_crowding_filter": f"NOT coalesce({_CROWD}, FALSE)", "simple_combined_filter": f"volatility_zscore <= 2.5 AND NOT volatility_zscore > 3 AND NOT {_CROWD}",
}


@query(f"WITH {_CTX}, sx AS (SELECT *, {S.neutral('60', '40')} AS sig FROM cx) SELECT symbol, count(*) FILTER (sig <> 0) AS n_signals, {', '.join(f'round(coalesce(count(*) FILTER (sig <> 0 AND coalesce({x}, FALSE)) / nullif(count(*) FILTER (sig <> 0), 0), 1.0), 6) AS kept_{k}' for k, x in _CF.items())} FROM sx GROUP BY symbol")
def signal_context_retention(spark, d):
    """S11."""
    df = I.add_context(I.add_rsi(M.bars(spark, d)))
    df = df.withColumn("signal", SG.rsi_signal("neutral-exit", F.col("rsi_14"), SG.RsiParams(14, 60, 40, 50)))
    return tidy(SG.retention(df))


@query(
    f"""{_EMA}, {S.rsi(14, 'rs')}, h AS (SELECT symbol, ts, y12 - y26 AS macd, sig, round(y12 - y26 - sig, 9) AS h FROM rec), c AS (SELECT *, CASE WHEN h > 0 AND {S.lag('h')} <= 0 THEN 1 WHEN h < 0 AND {S.lag('h')} >= 0 THEN -1 END AS crossed FROM h)
SELECT {KT}, {_SIG.format('CASE WHEN macd > sig THEN 1 ELSE -1 END')}, CAST(crossed AS BIGINT) AS crossed, round(rsi, 6) AS rsi_14 FROM c JOIN rs USING (symbol, ts)"""
)
def signal_macd_cross(spark, d):
    """S12."""
    return tidy(SG.macd_cross(M.bars(spark, d)).select("symbol", "ts", "signal", "crossed", "rsi_14"))


@query(f"WITH {S.BARS}, m AS (SELECT ts, symbol AS asset, close / 100 - 1.2 AS v FROM bars) SELECT ts, asset, round(v, 6) AS prediction_value, v > 0 AS selected FROM m")
def forecast_matrix(spark, d):
    """A matrix row for each time, back in long form; absent assets were NaN."""
    assets = ["click", "error", "purchase", "signup", "view"]
    wide = M.bars(spark, d).groupBy("ts").pivot("symbol", assets).agg(F.max(_close() / 100 - 1.2))
    row = wide.select("ts", F.array(*(F.coalesce(a, F.lit(float("nan"))) for a in assets)).alias("m"))
    return tidy(SG.matrix_to_long(row, "m", assets))


# ledgers
_LEDGER = f"{KT}, {S.r('target_position', 'position', 'turnover', 'gross_return', 'cost_return', 'net_return', 'equity')}, is_exposed"


def _ledger_columns(df: DataFrame) -> DataFrame:
    return tidy(df.select("symbol", "ts", "target_position", "position", "turnover", "gross_return", "cost_return", "net_return", "equity", "is_exposed"))


@query(f"WITH {RSI_LEDGER} SELECT {_LEDGER} FROM ledger")
def ledger_long(spark, d):
    """B1, B2."""
    return _ledger_columns(rsi_ledger(spark, d))


@query(f"WITH {RSI_SHORT} SELECT {_LEDGER} FROM ledger")
def ledger_long_short(spark, d):
    """B6."""
    return _ledger_columns(rsi_ledger(spark, d, long_only=False))


@query(f"WITH {_TRADES} SELECT symbol, trade_id, round(trade_return, 6) AS trade_return, bars_held FROM trades")
def trade_returns(spark, d):
    """B3."""
    return tidy(B.trade_returns(rsi_ledger(spark, d)))


_LOG = f"{S.r('entry_price', 'exit_price', 'exit_price - entry_price AS pnl', 'exit_price / entry_price - 1 AS pnl_percent')}, bars_held, CAST(1 AS BIGINT) AS side FROM tlog"


@query(f"WITH {RSI_LEDGER}, {S.trade_log()} SELECT symbol, trade_id, entry_time, exit_time, {_LOG}")
def trade_log(spark, d):
    """B4."""
    return tidy(B.trade_log(rsi_ledger(spark, d)))


@query(f"WITH {RSI_SHORT}, {S.trade_log()} SELECT symbol, trade_id, entry_time, exit_time, {_LOG}")
def trade_log_with_shorts(spark, d):
    """B4 on longs and shorts, in stretches of a day: a short neither opens nor closes a trade."""
    return tidy(B.trade_log(rsi_ledger(spark, d, long_only=False), seconds=86400))


@query(f"WITH {_ENS}, sg AS (SELECT symbol, ts, close, e * vol_scale AS signal FROM ens), {S.ledger('sg')}, {S.trades()} SELECT symbol, trade_id, round(trade_return, 6) AS trade_return, bars_held FROM trades")
def trade_returns_sized(spark, d):
    """B3 on the ensemble, whose positions are fractions: a run's return is the asset's, whatever the size; in stretches of a day."""
    s = SG.ensemble(M.bars(spark, d)).select("symbol", "ts", "close", "signal")
    return tidy(B.trade_returns(B.ledger(s, B.cost_rate(5.0, 1.0)), seconds=86400))


@query(f"WITH {RSI_SHORT}, {S.trades()}, fb AS (SELECT *, coalesce({S.lag('equity')}, 1.0) AS eb FROM trades_r) SELECT symbol, CAST(trade_id AS BIGINT) AS trade_id, {S.r('arg_max(position, ts) AS side')}, min(ts) AS entry_time, max(ts) AS exit_time, {S.r('arg_max(equity, ts) / arg_min(eb, ts) - 1 AS pnl')} FROM fb WHERE trade_id IS NOT NULL GROUP BY 1, 2")
def flip_trades(spark, d):
    """B5."""
    return tidy(B.flip_trades(rsi_ledger(spark, d, long_only=False)))


@query(f"WITH {RSI_LEDGER}, dl AS (SELECT *, position - coalesce({S.lag('position')}, 0) AS delta FROM ledger), f AS (SELECT *, row_number() OVER {S.P} AS k FROM dl WHERE delta <> 0) SELECT symbol || '-' || k AS order_id, symbol, ts, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, {S.r('abs(delta) AS quantity', 'close AS price')} FROM f")
def position_fills(spark, d):
    """B7."""
    return tidy(B.fills(rsi_ledger(spark, d)))


@query(f"WITH {RSI_LEDGER} SELECT symbol, CAST(floor(ts / 86400) AS BIGINT) AS day, {S.r('product(1 + net_return) - 1 AS daily_return')} FROM ledger GROUP BY 1, 2")
def daily_exports(spark, d):
    """B8."""
    out = B.exports(rsi_ledger(spark, d))["daily"]
    return tidy(out.select("symbol", F.datediff("date", F.lit("1970-01-01")).alias("day"), "daily_return"))


_SIZE = f"{S.BARS}, {S.rsi(14, 'rs', flat=100.0)}, s AS (SELECT *, {S.neutral()} AS signal FROM rs), sz AS (SELECT *, close - coalesce({S.lag('close')}, close) AS ch, round_even(1000 / close / 0.001, 0) * 0.001 AS qn, CASE WHEN signal > 0 THEN 2.0 ELSE 0.0 END AS qb FROM s)"


def _sized(q: str) -> str:
    return f"sum({q} * ch - abs({q} - coalesce({S.lag(q)}, 0)) * close * 0.0006)"


@query(
    f"""WITH {_SIZE}, fe AS (SELECT *, qn * ch - abs(qn - coalesce({S.lag('qn')}, 0)) * close * 0.0006 AS pn, qb * ch - abs(qb - coalesce({S.lag('qb')}, 0)) * close * 0.0006 AS pb, 1 + 0.5 * (coalesce(close / {S.lag('close')}, 1) - 1) AS g FROM sz)
SELECT {KT}, {S.r('qn AS q_notional', 'qb AS q_binary', f'10 + sum(pn) OVER {S.UP_TO} / 1000 AS eq_notional', f'10 + sum(pb) OVER {S.UP_TO} / 1000 AS eq_binary', f'product(g) OVER {S.UP_TO} AS eq_fraction')} FROM fe"""
)
def sized_ledgers(spark, d):
    """B9, B10."""
    s = SG.rsi_momentum(M.bars(spark, d)).select("symbol", "ts", "close", "signal")
    n = B.sized_ledger(s, "FIXED_NOTIONAL", 1000.0).select("symbol", "ts", F.col("quantity").alias("q_notional"), (F.col("equity") / 1000).alias("eq_notional"))
    b = B.sized_ledger(s, "BINARY", 2.0).select("symbol", "ts", F.col("quantity").alias("q_binary"), (F.col("equity") / 1000).alias("eq_binary"))
    f = B.sized_ledger(s, "FRACTIONAL_EQUITY", 0.5, capital=1.0).select("symbol", "ts", F.col("equity").alias("eq_fraction"))
    return tidy(n.join(b, ["symbol", "ts"]).join(f, ["symbol", "ts"]))


_VOL = S.roll("stddev_samp", "net_return", 20)


@query(f"WITH {RSI_LEDGER}, v AS (SELECT *, {_VOL} AS vol, coalesce(signal <> 0, FALSE) AS act FROM ledger), w AS (SELECT *, CASE WHEN vol >= 1e-12 THEN 1 / vol ELSE 1.0 END AS iv FROM v) SELECT ts, {S.r('avg(net_return) AS equal', 'coalesce(sum(net_return) FILTER (act) / nullif(count(*) FILTER (act), 0), 0.0) AS active', 'coalesce(sum(iv * net_return) / nullif(sum(iv), 0), 0.0) AS inverse_vol')}, count(*) FILTER (act) AS n_active FROM w GROUP BY ts")
def portfolio_returns(spark, d):
    """B11."""
    led = rsi_ledger(spark, d)
    out = None
    for k in ("equal", "active", "inverse_vol"):
        p = B.portfolio(led, k).withColumnRenamed("portfolio_return", k)
        out = p if out is None else out.join(p.drop("n_active"), "ts")
    return tidy(out)


@query(
    f"""WITH {_TRADES}, r AS (SELECT t.*, s.sim, md5('7|' || s.sim || '|' || trade_id) AS o FROM trades t, range(50) s(sim)),
e AS (SELECT *, product(1 + trade_return) OVER (PARTITION BY symbol, sim ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM r),
dd AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY symbol, sim ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1 AS d FROM e), w AS (SELECT symbol, sim, min(least(d, 0.0)) AS dd FROM dd GROUP BY 1, 2)
SELECT symbol, {S.r('quantile_cont(-dd, 0.5) AS dd_q50', 'quantile_cont(-dd, 0.95) AS dd_q95')} FROM w GROUP BY symbol"""
)
def monte_carlo_drawdown(spark, d):
    """B12."""
    return tidy(B.monte_carlo(B.trade_returns(rsi_ledger(spark, d))))


_TM = """tm AS (SELECT l.symbol, coalesce(t.trade_count, 0) AS trade_count, coalesce(t.win_rate, 0.0) AS win_rate, t.profit_factor, l.exposure FROM (SELECT symbol, avg(CASE WHEN is_exposed THEN 1.0 ELSE 0.0 END) AS exposure FROM ledger GROUP BY symbol) l
LEFT JOIN (SELECT symbol, count(*) AS trade_count, avg(CASE WHEN trade_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(CASE WHEN trade_return > 0 THEN trade_return ELSE 0.0 END) / nullif(sum(CASE WHEN trade_return < 0 THEN -trade_return ELSE 0.0 END), 0) AS profit_factor FROM trades GROUP BY symbol) t USING (symbol))"""


@query(f"WITH {_TRADES}, {_TM} SELECT symbol, trade_count, {S.r('win_rate', 'profit_factor', 'exposure')} FROM tm")
def trade_metrics(spark, d):
    """A7."""
    led = rsi_ledger(spark, d)
    return tidy(A.trade_metrics(B.trade_returns(led), led))


def _reasons(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), '|')"


_CONTRACT = _reasons(("max_drawdown < -0.16", "max_drawdown"), ("max_daily_drawdown < -0.08", "max_daily_drawdown"), ("cagr < 0", "cagr"))
_FACTOR = "coalesce(profit_factor, CASE WHEN win_rate > 0 THEN 'infinity'::DOUBLE ELSE 0.0 END)"
_GATE = _reasons(("trade_count < 3", "trade_count"), ("abs(max_drawdown) > 0.25", "max_drawdown"), (f"{_FACTOR} < 1", "profit_factor"), ("smart_sharpe < 0", "sharpe"), ("cumulative_return < 0", "cumulative_return"))
_MTM = f"{_TRADES}, {S.metrics()}, {_TM}, mt AS (SELECT * FROM metrics JOIN tm USING (symbol))"


def scored(spark, d) -> DataFrame:
    led = rsi_ledger(spark, d)
    return A.metrics(led).join(A.trade_metrics(B.trade_returns(led), led), "symbol")


@query(f"WITH {_MTM}, g AS (SELECT symbol, {_CONTRACT} AS reasons, {_GATE} AS gate_reasons, trade_count > 0 AND trade_count < 50 AS low_trades FROM mt) SELECT *, reasons = '' AS passed, gate_reasons = '' AS gate_passed FROM g")
def gates(spark, d):
    """B13, B14, A9; three trades are enough here, so that the other rules decide too."""
    out = B.pipeline_gate(B.contract(scored(spark, d)), min_trades=3)
    return out.select("symbol", F.array_join("reasons", "|").alias("reasons"), F.array_join("gate_reasons", "|").alias("gate_reasons"), "low_trades", "passed", "gate_passed")


# aggregates
@query(f"WITH {RSI_LEDGER}, {S.metrics()} SELECT symbol, day, {S.r('daily_dd', 'dr AS daily_return')} FROM metrics_d")
def daily_equity(spark, d):
    """A3."""
    out = A.daily(rsi_ledger(spark, d))
    return tidy(out.select("symbol", F.datediff("date", F.lit("1970-01-01")).alias("day"), "daily_dd", "daily_return"))


_BAR = f"{S.r('product(1 + r) - 1 AS cumulative_return', 'stddev_samp(r) * sqrt(2190.0) AS annualized_vol', 'CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(2190.0) ELSE 0.0 END AS smart_sharpe', 'min(dd) AS max_drawdown')}, count(*) AS n_bars"


@query(f"WITH {RSI_LEDGER}, p AS (SELECT ts, avg(net_return) AS r FROM ledger GROUP BY ts), e AS (SELECT *, product(1 + r) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM p), q AS (SELECT *, eq / max(eq) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM e) SELECT {_BAR} FROM q")
def portfolio_metrics(spark, d):
    """Of the whole portfolio, from cells of two days each."""
    return tidy(A.bar_metrics(B.portfolio(rsi_ledger(spark, d)), "portfolio_return", seconds=2 * 86400))


@query(f"WITH {RSI_LEDGER}, e AS (SELECT symbol, ts, net_return AS r, product(1 + net_return) OVER {S.UP_TO} AS eq FROM ledger), q AS (SELECT *, eq / max(eq) OVER {S.UP_TO} - 1 AS dd FROM e) SELECT symbol, {_BAR} FROM q GROUP BY symbol")
def symbol_bar_metrics(spark, d):
    """A6 by symbol."""
    return tidy(A.bar_metrics(rsi_ledger(spark, d), "net_return", ("symbol",)))


@query(f"WITH {RSI_LEDGER} SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, {S.r('corr(a.asset_return, b.asset_return) AS correlation')}, count(*) AS n_common FROM ledger a JOIN ledger b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2")
def return_correlations(spark, d):
    """A16."""
    return tidy(A.correlations(rsi_ledger(spark, d)))


@query(f"WITH {RSI_SHORT} SELECT symbol, {S.r('coalesce(sum(net_return) FILTER (position > 0), 0.0) AS long_return', 'coalesce(sum(net_return) FILTER (position < 0), 0.0) AS short_return')}, count(*) FILTER (position > 0) AS long_bars, count(*) FILTER (position < 0) AS short_bars FROM ledger GROUP BY symbol")
def side_attribution(spark, d):
    """A17, with shorts."""
    return tidy(A.attribution(rsi_ledger(spark, d, long_only=False)))


@query(
    f"""WITH {RSI_SHORT}, p AS (SELECT symbol, ts >= 1705276800 AS is_post, product(1 + net_return) - 1 AS c, coalesce(sum(net_return) FILTER (position > 0), 0.0) AS l, coalesce(sum(net_return) FILTER (position < 0), 0.0) AS s, sum(turnover) AS turnover, sum(cost_return) AS cost_drag, coalesce(stddev_samp(net_return), 0.0) AS volatility FROM ledger GROUP BY 1, 2)
SELECT symbol, is_post, {S.r('c AS cumulative_return', 'l AS long_return', 's AS short_return', 'turnover', 'cost_drag', 'volatility')}, CASE WHEN NOT is_post THEN NULL WHEN c >= -0.05 THEN 'normal_drawdown_within_expected_range' WHEN cost_drag > abs(c) * 0.5 THEN 'cost_turnover_drag' WHEN abs(s) > abs(l) THEN 'short_side_failure' ELSE 'market_regime_shift_to_chop' END AS failure FROM p"""
)
def drawdown_attribution(spark, d):
    """A18."""
    return tidy(A.period_attribution(rsi_ledger(spark, d, long_only=False), "2024-01-15 00:00:00"))


@query(f"WITH {RSI_LEDGER}, c AS (SELECT *, coalesce(position <> {S.lag('position')}, FALSE) AS ch FROM ledger) SELECT symbol, count(*) FILTER (ch) AS n_changes, {S.r('sum(turnover) AS turnover')} FROM c GROUP BY symbol")
def position_changes(spark, d):
    """A19."""
    return tidy(A.position_changes(rsi_ledger(spark, d)))


_GS = f"{GATED}, gs AS (SELECT *, CASE WHEN raw_signal = 1 AND NOT ok THEN NULL ELSE raw_signal END AS signal FROM gated)"


@query(f"WITH {_GS}, h AS (SELECT *, {S.held('signal')} AS held FROM gs), o AS (SELECT *, coalesce(signal = 1 AND coalesce({S.lag('held')}, 0) <> 1, FALSE) AS op FROM h) SELECT symbol, count(signal) AS n_signals, count(*) FILTER (signal = 1) AS n_entries, count(*) FILTER (signal = 0) AS n_exits, count(*) FILTER (raw_signal = 1 AND signal IS NULL) AS n_suppressed, count(*) FILTER (op) AS n_trades FROM o GROUP BY symbol")
def run_summary(spark, d):
    """A20."""
    from .operators.asof import gate

    return tidy(A.run_summary(gate(*gate_inputs(spark, d), max_spread=300.0, depth=(-0.2, None))))


@query(f"WITH {RSI_LEDGER}, {S.metrics()}, {RSI_SHORT.split(', sg AS')[1].join(['sg2 AS', '']).replace('sg2 AS (', 'sg2 AS (', 1).replace('ledger', 'short').replace('FROM sg)', 'FROM sg2)')}, {S.metrics('short', name='m2')} SELECT m2.symbol, {S.r(*(f'm2.{n} - metrics.{n} AS delta_{n}' for n in ('cumulative_return', 'smart_sharpe', 'max_drawdown')))} FROM m2 JOIN metrics USING (symbol)")
def metric_deltas(spark, d):
    """Long-short less long-only."""
    a, b = A.metrics(rsi_ledger(spark, d)), A.metrics(rsi_ledger(spark, d, long_only=False))
    return tidy(A.deltas(a, b, ["cumulative_return", "smart_sharpe", "max_drawdown"]))


@query(f"WITH {RSI_LEDGER}, e AS (SELECT *, max(equity) OVER {S.UP_TO} AS pk, equity - {S.lag('equity')} AS dq, equity / {S.lag('equity')} - 1 AS rq FROM ledger) SELECT symbol, {S.r('max(pk - equity) AS abs_drawdown', 'max((pk - equity) / pk) AS pct_drawdown', 'sum(CASE WHEN dq > 0 THEN dq ELSE 0.0 END) AS gross_profit', 'sum(CASE WHEN dq < 0 THEN -dq ELSE 0.0 END) AS gross_loss', 'coalesce(avg(rq) / nullif(stddev_samp(rq), 0) * sqrt(525600.0), 0.0) AS bar_sharpe')} FROM e GROUP BY symbol")
def equity_summary(spark, d):
    """A23."""
    return tidy(A.equity_summary(rsi_ledger(spark, d)))
