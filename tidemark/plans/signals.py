"""Strategy rules: each adds `signal` (1, 0, -1, or null for hold) to bars, keyed by symbol."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEYS, before, forward_fill, need, rolling, safe_div
from ..operators.scan import add_macd
from ..operators.stretches import WEEK, add_held


@dataclass(frozen=True)
class Strategy:
    name: str
    build: Callable[..., DataFrame]
    vectorised: bool = True


@dataclass
class Strategies:
    """Strategies by name; one that depends on its own path is refused."""

    items: dict[str, Strategy] = field(default_factory=dict)

    def add(self, name: str, vectorised: bool = True):
        def register(f):
            self.items[self.normal(name)] = Strategy(self.normal(name), f, vectorised)
            return f

        return register

    @staticmethod
    def normal(name: str) -> str:
        """Names differ in neither case, spaces nor dashes."""
        return name.strip().lower().replace("-", "_").replace(" ", "_")

    def signals(self, name: str, df: DataFrame, **params) -> DataFrame:
        found = self.items.get(self.normal(name))
        if found is None:
            raise ValueError(f"no strategy {name}")
        if not found.vectorised:
            raise ValueError(f"{name} depends on its own path")
        return found.build(df, **params)


STRATEGIES = Strategies()


@dataclass(frozen=True)
class RsiParams:
    """The rules that hold for RSI thresholds."""

    period: int = 14
    upper: float = 70.0
    lower: float = 30.0
    exit: float = 50.0
    squeeze_only: bool = False

    def __post_init__(self):
        if self.period < 2 or not 0 <= self.lower < self.exit < self.upper <= 100:
            raise ValueError("an RSI strategy needs period >= 2 and lower < exit < upper within 0..100")


def _first(*pairs: tuple[Column, int]) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out


def _held(x: Column, keys) -> Column:
    return F.coalesce(forward_fill(x, keys), F.lit(0))


@STRATEGIES.add("bb_breakout")
def bb_breakout(df: DataFrame, n: int = 20, k: float = 2.0, regime: int = 50, keys=KEYS) -> DataFrame:
    """Over the upper band and the regime mean in, under the middle out."""
    if n < 2 or regime < 2 or k <= 0:
        raise ValueError("bb_breakout needs n, regime >= 2 and k > 0")
    df = I.add_bands(df, n, k, keys).withColumn("regime_sma", rolling(F.avg, F.col("close"), regime, keys))
    return df.withColumn("signal", _first(((F.col("close") > F.col(f"bb_upper_{n}")) & (F.col("close") > F.col("regime_sma")), 1), (F.col("close") < F.col(f"bb_mid_{n}"), 0)))


@STRATEGIES.add("rsi_sma")
def rsi_sma(df: DataFrame, fast: int = 10, slow: int = 30, period: int = 14, side: float = 50.0, above: bool = True, keys=KEYS) -> DataFrame:
    """Fast mean crosses the slow one upward with RSI over `side` (without `above`: under it) in, downward out."""
    if not 1 <= fast < slow:
        raise ValueError("rsi_sma needs fast < slow")
    df = I.add_rsi(df, period, keys, name="rsi").withColumns({"sma_fast": rolling(F.avg, F.col("close"), fast, keys), "sma_slow": rolling(F.avg, F.col("close"), slow, keys)})
    a, b = F.col("sma_fast"), F.col("sma_slow")
    up, down = (a > b) & (before(a, 1, keys) <= before(b, 1, keys)), (a < b) & (before(a, 1, keys) >= before(b, 1, keys))
    return df.withColumns({"cross_up": up, "cross_down": down}).withColumn("signal", _first((F.col("cross_up") & (F.col("rsi") > side if above else F.col("rsi") < side), 1), (F.col("cross_down"), 0)))


def rsi_pulses(variant: str, rsi: Column, p: RsiParams, ready: Column | None = None) -> list[Column]:
    """S3: what each bar says, null where it says nothing; the signal is the sum of the pulses, each held until its next."""
    ok = F.lit(True) if ready is None else ready
    high, low = (rsi >= p.upper) & ok, (rsi <= p.lower) & ok
    if variant == "neutral-exit":
        return [_first((high, 1), (rsi < p.exit, 0)), _first((low, -1), (rsi > p.exit, 0))]
    if variant == "extreme-zone":
        return [F.when(high, 1).when(low, -1).otherwise(0)]
    if variant == "always-in":
        return [_first((high, 1), (low, -1))]
    if variant == "mean-reversion":
        return [_first((low, 1), (rsi >= p.exit, 0)), _first((high, -1), (rsi <= p.exit, 0))]
    if variant == "long-flat":
        return [_first((high, 1), (rsi < p.exit, 0))]
    if variant in ("buy-and-hold", "flat"):
        return [F.lit(int(variant != "flat"))]
    raise ValueError(f"no variant {variant}")


def rsi_signal(variant: str, rsi: Column, p: RsiParams, keys=KEYS, ready: Column | None = None) -> Column:
    """S3: the seven variants on a column of RSI; ready: a condition of every entry."""
    pulses = rsi_pulses(variant, rsi, p, ready)
    if variant in ("extreme-zone", "buy-and-hold", "flat"):  # every bar says something
        return pulses[0]
    return reduce(lambda a, b: a + b, (_held(x, keys) for x in pulses))


def add_rsi_signal(df: DataFrame, variant: str, rsi: Column, p: RsiParams, keys=KEYS, ready: Column | None = None, seconds: int = WEEK) -> DataFrame:
    """S3: the column `signal` of rsi_signal(), its pulses held in stretches instead of over a whole history."""
    pulses = {f"_pulse_{i}": x for i, x in enumerate(rsi_pulses(variant, rsi, p, ready))}
    df = add_held(df, pulses, keys, seconds)
    return df.withColumn("signal", reduce(lambda a, b: a + b, (F.coalesce(n, F.lit(0)) for n in pulses))).drop(*pulses)


RSI_VARIANTS = ("neutral-exit", "extreme-zone", "always-in", "mean-reversion", "long-flat", "buy-and-hold", "flat")


@STRATEGIES.add("rsi_momentum")
def rsi_momentum(df: DataFrame, params: RsiParams = RsiParams(), variant: str = "neutral-exit", keys=KEYS) -> DataFrame:
    """RSI here is the indicator's, 100 where nothing fell."""
    df = I.add_rsi(df, params.period, keys, flat=100.0, name="rsi")
    if params.squeeze_only:
        df = I.squeeze(df, keys=keys)
    return df.withColumn("signal", rsi_signal(variant, F.col("rsi"), params, keys, F.col("squeeze") if params.squeeze_only else None))


ENSEMBLE = (RsiParams(), RsiParams(14, 75, 25, 55), RsiParams(21), RsiParams(7, 75, 25, 50))


def ensemble(df: DataFrame, members=ENSEMBLE, scaled: bool = True, target: float = 0.02, n: int = 20, keys=KEYS) -> DataFrame:
    """Rounded (half to even) mean of the members, scaled by target volatility over the mean absolute return, in [0.25, 1]."""
    for p in sorted({m.period for m in members}):
        df = I.add_rsi(df, p, keys, flat=100.0, name=f"_rsi_{p}")
    votes = reduce(lambda a, b: a + b, (rsi_signal("neutral-exit", F.col(f"_rsi_{m.period}"), m, keys) for m in members))
    df = df.withColumns({"ensemble_signal": F.rint(votes / len(members)).cast("int"), "_abs": F.abs(I.returns(F.col("close"), 1, keys))})
    scale = F.least(F.greatest(F.coalesce(safe_div(F.lit(target), rolling(F.avg, F.col("_abs"), n, keys)), F.lit(1.0)), F.lit(0.25)), F.lit(1.0))
    df = df.withColumn("vol_scale", scale).drop("_abs", *(f"_rsi_{p}" for p in {m.period for m in members}))
    return df.withColumn("signal", F.col("ensemble_signal") * F.col("vol_scale") if scaled else F.col("ensemble_signal").cast("double"))


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _result(df: DataFrame, long: Column, short: Column, context: Column, leave: Column) -> DataFrame:
    df = df.withColumns({"long_setup": _no(long & context), "short_setup": _no(short), "context_filter_passed": _no(context), "exit_signal": _no(leave)})
    return df.withColumn("signal", _first((F.col("long_setup"), 1), (F.col("exit_signal"), 0)))


@STRATEGIES.add("forced_flow_band_reclaim")
def forced_flow_band_reclaim(df: DataFrame, context: bool = True, strict: bool = False, flow: bool = True, flush: bool = False, funding: bool = True, basis: bool = False, max_spread: float | None = None, mid_exit: bool = True) -> DataFrame:
    """A lower band reclaimed after forced selling, out at the middle band; filters use the columns there are."""
    side = "_strict" if strict else ""
    need(df, "close", "bb_mid_20", f"bb_reclaim_lower{side}")
    has, ok = set(df.columns), F.lit(True)
    if context and flow:
        proxies = [_no(F.col(c)) for c in ("liquidation_proxy_long", "forced_selling_proxy") if c in has]
        if not proxies:
            raise ValueError("a forced-flow proxy is needed")
        ok = ok & reduce(lambda a, b: a | b, proxies)
    if context and flush:
        ok = ok & _no(F.col("oi_flush"))
    for wanted, column in ((funding, "funding_zscore_30"), (basis, "basis_zscore_60")):
        if context and wanted:
            need(df, column)
            ok = ok & (F.col(column) <= 0)
    if max_spread is not None and "spread_bps" in has:
        ok = ok & (F.col("spread_bps") <= max_spread)
    shorts = [_no(F.col(c)) for c in (f"bb_reclaim_upper{side}", "liquidation_proxy_short", "forced_buying_proxy") if c in has]
    return _result(df, _no(F.col(f"bb_reclaim_lower{side}")), reduce(lambda a, b: a | b, shorts, F.lit(False)), ok, F.col("close") >= F.col("bb_mid_20") if mid_exit else F.lit(False))


@STRATEGIES.add("funding_exhaustion_reversal")
def funding_exhaustion_reversal(df: DataFrame, oversold: float = 30.0, overbought: float = 70.0, middle: float = 50.0, mid_exit: bool = True, funding: float = 2.0, extended: bool = True, extension: float = 0.02, turn: bool = True, basis: bool = False, basis_limit: float = 1.5, context: bool = True, max_spread: float | None = None) -> DataFrame:
    """Oversold while funding is exhausted, the price extended and momentum turning; out at the RSI's middle.

    The extension is price_extension_20, or ret_60 where there is none.
    """
    if not 0 < oversold < overbought < 100 or not 0 < middle < 100 or funding <= 0 or extension < 0 or basis_limit <= 0 or (max_spread or 0) < 0:
        raise ValueError("funding_exhaustion_reversal needs 0 < oversold < overbought < 100 and limits that aren't negative")
    need(df, "rsi_14")
    has, ok, rsi = set(df.columns), F.lit(True), F.col("rsi_14")
    if context:
        need(df, "funding_zscore_30")
        ok = ok & (F.col("funding_zscore_30") <= -funding)
    if extended:
        stretch = "price_extension_20" if "price_extension_20" in has else "ret_60"
        need(df, stretch)
        ok = ok & (F.col(stretch) <= -extension)
    if turn:
        need(df, "momentum_slope_10")
        ok = ok & (F.col("momentum_slope_10") > 0)
    if basis:
        need(df, "basis_zscore_60")
        ok = ok & (F.col("basis_zscore_60") <= -basis_limit)
    if max_spread is not None and "spread_bps" in has:
        ok = ok & (F.col("spread_bps") <= max_spread)
    short = (rsi >= overbought) & (F.col("funding_zscore_30") >= funding if "funding_zscore_30" in has else F.lit(False)) & (F.col("momentum_slope_10") < 0 if "momentum_slope_10" in has else F.lit(False))
    return _result(df, rsi <= oversold, short, ok, rsi >= middle if mid_exit else F.lit(False))


@STRATEGIES.add("oi_confirmed_trend")
def oi_confirmed_trend(df: DataFrame, strength: float = 0.0, distance: float = 0.0, expansion: bool = True, oi: float = 1.0, oi_change: float = 0.0, avoid_funding: bool = True, crowded_funding: float = 1.5, avoid_basis: bool = True, crowded_basis: float = 1.5, context: bool = True, max_spread: float | None = None, trend_exit: bool = True) -> DataFrame:
    """An up-trend over its 20-span mean that open interest confirms, by its z-score or its change, and neither funding nor basis crowds; out under the mean."""
    if (max_spread or 0) < 0:
        raise ValueError("max_spread must not be negative")
    need(df, "close", "ema_20", "ema_dist_20", "trend_strength_50_200")
    has, ok, t, mean = set(df.columns), F.lit(True), F.col("trend_strength_50_200"), F.col("ema_20")
    confirmed = F.lit(True)
    if context and expansion:
        signs = [F.col(c) > limit for c, limit in (("oi_zscore_60", oi), ("oi_change_pct_5", oi_change)) if c in has]
        if not signs:
            raise ValueError("oi_confirmed_trend needs oi_zscore_60 or oi_change_pct_5")
        confirmed = reduce(lambda a, b: a | b, signs)
        ok = ok & confirmed
    for wanted, column, limit in ((avoid_funding, "funding_zscore_30", crowded_funding), (avoid_basis, "basis_zscore_60", crowded_basis)):
        if context and wanted:
            need(df, column)
            ok = ok & (F.col(column) < limit)
    if max_spread is not None and "spread_bps" in has:
        ok = ok & (F.col("spread_bps") <= max_spread)
    return _result(df, (t > strength) & (F.col("ema_dist_20") > distance) & (F.col("close") > mean), (t < -strength) & (F.col("close") < mean) & confirmed, ok, F.col("close") < mean if trend_exit else F.lit(False))


def trend_filtered(df: DataFrame, fast: int = 20, slow: int = 50, keys=KEYS) -> DataFrame:
    """The signal while the fast mean is over the slow one, else 0."""
    return df.withColumn("signal", F.col("signal") * F.coalesce((rolling(F.avg, F.col("close"), fast, keys) > rolling(F.avg, F.col("close"), slow, keys)).cast("int"), F.lit(0)))


CHOP_FILTERS = ("none", "efficiency", "moderate_vol", "no_high_vol", "cooldown")


def chop_filtered(df: DataFrame, kind: str, keys=KEYS) -> DataFrame:
    """The signal where the filter lets it through, else 0. Needs efficiency_ratio and vol_z; the cooldown is the 12 bars from a losing one on."""
    z = F.col("vol_z")
    loss = (before(F.col("signal"), 1, keys) * I.returns(F.col("close"), 1, keys)) < 0
    if kind == "cooldown":
        df = df.withColumn("_loss", _no(loss))
        loss = F.col("_loss")
    through = {"none": F.lit(True), "efficiency": F.col("efficiency_ratio") >= 0.3, "moderate_vol": (z >= -1) & (z <= 2), "no_high_vol": z <= 2.5, "cooldown": I.cooled(loss, 12, keys)}[kind]
    return df.withColumn("signal", F.when(_no(through), F.col("signal")).otherwise(0)).drop("_loss")


CONTEXT_FILTERS = ("unfiltered_champion", "volatility_extreme_disable", "moderate_volatility_only", "trend_strength_filter", "liquidity_stress_disable", "funding_crowding_filter", "simple_combined_filter")


def context_filter(kind: str, most: float = 2.5, moderate: tuple[float, float] = (-1.0, 2.0)) -> Column:
    """Where the filter lets the signal through; needs signal and the columns of add_context(). What isn't known lets nothing
    through, except that crowding by the RSI's extremes has to be known to block."""
    s, z, calm = F.col("signal"), F.col("volatility_zscore"), ~F.col("liquidity_stress")
    crowded = ((s > 0) & F.col("rsi_high")) | ((s < 0) & F.col("rsi_low"))
    through = {
        "unfiltered_champion": F.lit(True), "volatility_extreme_disable": z <= most, "moderate_volatility_only": z.between(*moderate), "trend_strength_filter": F.col("trend_up"),
        "liquidity_stress_disable": calm, "funding_crowding_filter": ~_no(crowded), "simple_combined_filter": (z <= most) & calm & ~crowded,
    }
    return _no(through[kind])


def context_filtered(df: DataFrame, kind: str, **limits) -> DataFrame:
    """The signal where the filter lets it through, else 0."""
    return df.withColumn("signal", F.when(context_filter(kind, **limits), F.col("signal")).otherwise(0))


def context_runs(df: DataFrame, kinds=CONTEXT_FILTERS, **limits) -> DataFrame:
    """A copy of each bar for each filter: filter_id, raw_signal, and signal, 0 where the filter doesn't let it through."""
    runs = F.array(*(F.struct(F.lit(k).alias("filter_id"), F.when(context_filter(k, **limits), F.col("signal")).otherwise(0).alias("signal")) for k in kinds))
    plain = [c for c in df.columns if c != "signal"]
    return df.select(*plain, F.col("signal").alias("raw_signal"), F.explode(runs).alias("_run")).select(*plain, "raw_signal", "_run.filter_id", "_run.signal")


def retention(df: DataFrame, kinds=CONTEXT_FILTERS, keys=KEYS) -> DataFrame:
    """For each filter, the share of bars with a signal that keep it; without any signal all are kept."""
    on = F.coalesce(F.col("signal"), F.lit(0)) != 0
    kept = {k: F.count_if(on & context_filter(k)) for k in kinds}
    return df.groupBy(*keys).agg(F.count_if(on).alias("n_signals"), *(F.coalesce(safe_div(n, F.count_if(on)), F.lit(1.0)).alias(f"kept_{k}") for k, n in kept.items()))


@STRATEGIES.add("macd_cross")
def macd_cross(df: DataFrame, keys=KEYS) -> DataFrame:
    """On every bar 1 while MACD is over its signal line, else -1, with the RSI beside it; crossed: 1 where MACD crosses
    that line upward, -1 downward, to nine places."""
    df = I.add_rsi(add_macd(df, keys=keys), 14, keys)
    h = F.round("macd_hist", 9)
    was = before(h, 1, keys)
    crossed = _first(((h > 0) & (was <= 0), 1), ((h < 0) & (was >= 0), -1))
    return df.withColumns({"signal": F.when(F.col("macd") > F.col("macd_signal"), 1).otherwise(-1), "crossed": crossed})


def matrix_to_long(df: DataFrame, values: str, assets: list[str], name: str = "prediction_value") -> DataFrame:
    """A row of values for each asset (array column) as rows; NaN and infinities go. selected: a value over 0."""
    out = df.select("ts", F.posexplode(values).alias("_i", name)).withColumn("asset", F.array(*map(F.lit, assets))[F.col("_i")])
    return out.where(~F.isnan(name) & (F.abs(name) != float("inf"))).withColumn("selected", F.col(name) > 0).select("ts", "asset", name, "selected")
