"""Feature composites and the feature pipeline, all on one partitioning by symbol and order by time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEYS, before, need, quantile, safe_div, zscore
from ..operators.scan import add_trend


@dataclass(frozen=True)
class Feature:
    name: str
    transform: Callable[[DataFrame], DataFrame]
    category: str = "price"
    lookback: int = 0
    tags: tuple[str, ...] = ()


@dataclass
class Registry:
    """Named transforms with metadata; lookback bounds the rows a halo must copy."""

    items: dict[str, Feature] = field(default_factory=dict)

    def add(self, name: str, category: str = "price", lookback: int = 0, tags: tuple[str, ...] = ()):
        def register(f: Callable[[DataFrame], DataFrame]):
            if name in self.items:
                raise ValueError(f"{name} is registered already")
            self.items[name] = Feature(name, f, category, lookback, tags)
            return f

        return register

    def apply(self, df: DataFrame, *names: str) -> DataFrame:
        for n in names:
            df = self.items[n].transform(df)
        return df


FEATURES = Registry()

@FEATURES.add("funding", "derivatives", 90)
def add_funding(df: DataFrame, keys=KEYS, threshold: float = 2.0) -> DataFrame:
    """F1."""
    need(df, "funding_rate")
    x = F.col("funding_rate")
    df = df.withColumns({"funding_zscore_30": zscore(x, 30, keys), "_q": quantile(x, 0.9, 90, keys, 30)})
    z = F.col("funding_zscore_30")
    return df.withColumns({"funding_high_q90": F.coalesce(x >= F.col("_q"), F.lit(False)), "funding_extreme_pos": F.coalesce(z > threshold, F.lit(False)), "funding_extreme_neg": F.coalesce(z < -threshold, F.lit(False)), "funding_reset": F.coalesce((F.abs(before(z, 1, keys)) > threshold) & (F.abs(z) < 0.5), F.lit(False))}).drop("_q")


@FEATURES.add("open_interest", "derivatives", 61)
def add_interest(df: DataFrame, keys=KEYS, move: float = 0.03, threshold: float = 2.0) -> DataFrame:
    """F2, W21."""
    need(df, "open_interest")
    x = F.col("open_interest")
    df = df.withColumns({"oi_diff_1": x - before(x, 1, keys), "oi_diff_5": x - before(x, 5, keys), "oi_change_pct_5": safe_div(x, before(x, 5, keys)) - 1, "oi_zscore_60": zscore(x, 60, keys)})
    p, z = F.col("oi_change_pct_5"), F.col("oi_zscore_60")
    return df.withColumns({"oi_expansion": F.coalesce((z > threshold) | (p > move), F.lit(False)), "oi_flush": F.coalesce((z < -threshold) | (p < -move), F.lit(False))})


@FEATURES.add("basis", "derivatives", 60)
def add_basis(df: DataFrame, keys=KEYS, threshold: float = 2.0) -> DataFrame:
    """F3."""
    need(df, "basis")
    x = F.col("basis")
    df = df.withColumns({"basis_zscore_60": zscore(x, 60, keys), "_q": quantile(x, 0.9, 90, keys, 30)})
    z = F.col("basis_zscore_60")
    return df.withColumns({"basis_high_q90": F.coalesce(x >= F.col("_q"), F.lit(False)), "perp_premium_extreme": F.coalesce(z > threshold, F.lit(False)), "perp_discount_extreme": F.coalesce(z < -threshold, F.lit(False))}).drop("_q")


def add_derivatives(df: DataFrame, keys=KEYS, allow_missing: bool = True) -> DataFrame:
    """whichever of funding, open interest and basis is there."""
    for column, add in (("funding_rate", add_funding), ("open_interest", add_interest), ("basis", add_basis)):
        if column in df.columns:
            df = add(df, keys)
        elif not allow_missing:
            need(df, column)
    return df


#: Tag, regime and the value that it stands for.
TAGS = (
    ("tag_trend_up", "trend_regime", "up"), ("tag_trend_down", "trend_regime", "down"), ("tag_high_vol", "volatility_regime", "high_vol"), ("tag_low_vol", "volatility_regime", "low_vol"),
    ("tag_positive_funding_extreme", "funding_regime", "positive_extreme"), ("tag_negative_funding_extreme", "funding_regime", "negative_extreme"), ("tag_oi_expansion", "oi_regime", "expansion"),
    ("tag_oi_flush", "oi_regime", "flush"), ("tag_perp_premium_extreme", "basis_regime", "premium_extreme"), ("tag_perp_discount_extreme", "basis_regime", "discount_extreme"),
)


def add_regimes(df: DataFrame, keys=KEYS, trend_threshold: float = 0.0, allow_missing: bool = True) -> DataFrame:
    """five regimes, their tags and the regimes joined. Needs trend_strength_50_200 and realized_vol_60.

    What isn't known yet is the middle regime; a derivative whose flags aren't there is `missing`, or an error without allow_missing.
    """
    need(df, "trend_strength_50_200", "realized_vol_60")
    t, v = F.col("trend_strength_50_200"), F.col("realized_vol_60")
    df = df.withColumns({"_low": quantile(v, 0.25, 240, keys, 120), "_high": quantile(v, 0.75, 240, keys, 120)})
    ladder = {
        "trend_regime": F.when(t > trend_threshold, "up").when(t < -trend_threshold, "down").otherwise("range"),
        "volatility_regime": F.when(v > F.col("_high"), "high_vol").when(v < F.col("_low"), "low_vol").otherwise("normal_vol"),
    }
    flags = {"funding_regime": (("funding_extreme_pos", "positive_extreme"), ("funding_extreme_neg", "negative_extreme")), "oi_regime": (("oi_expansion", "expansion"), ("oi_flush", "flush")), "basis_regime": (("perp_premium_extreme", "premium_extreme"), ("perp_discount_extreme", "discount_extreme"))}
    for name, ((a, is_a), (b, is_b)) in flags.items():
        if a in df.columns and b in df.columns:
            ladder[name] = F.when(F.col(a), is_a).when(F.col(b), is_b).otherwise("neutral")
        elif allow_missing:
            ladder[name] = F.lit("missing")
        else:
            need(df, a, b)
    df = df.withColumns(ladder).drop("_low", "_high")
    return df.withColumns({tag: F.col(regime) == value for tag, regime, value in TAGS} | {"market_regime_tags": F.concat_ws("|", *ladder)})


def add_forced_flow(df: DataFrame, shock: float = 2.0, spike: float = 2.0, keys=KEYS) -> DataFrame:
    """shocks of return and volume in deviations, and what they suggest together with a flush and a reclaimed band.

    Needs ret_1 and volume_zscore_20; without oi_flush or the bands' reclaims these count as false.
    """
    there = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    flush, lower, upper = there("oi_flush"), there("bb_reclaim_lower"), there("bb_reclaim_upper")
    r = zscore(F.col("ret_1"), 60, keys)
    df = df.withColumns({"return_shock_down": r < -shock, "return_shock_up": r > shock, "volume_shock": F.col("volume_zscore_20") > spike, "oi_flush_event": flush})
    event = F.col("volume_shock") & F.col("oi_flush_event")
    df = df.withColumns({"forced_selling_proxy": F.col("return_shock_down") & event, "forced_buying_proxy": F.col("return_shock_up") & event})
    return df.withColumns({"liquidation_proxy_long": F.col("forced_selling_proxy") & lower, "liquidation_proxy_short": F.col("forced_buying_proxy") & upper})


STAGES = ("returns", "volatility", "trend", "bands", "momentum", "volume", "derivatives", "forced_flow", "regimes")


def feature_columns(df: DataFrame, inputs: list[str]) -> list[str]:
    """What a pipeline added."""
    return [c for c in df.columns if c not in inputs]


def no_future(df: DataFrame) -> DataFrame:
    """Refuses columns named as of the future."""
    bad = [c for c in df.columns if "future" in c.lower() or "lead" in c.lower().split("_")]
    if bad:
        raise ValueError(f"columns of the future: {', '.join(bad)}")
    return df


def feature_dataset(df: DataFrame, keys=KEYS, stages=STAGES) -> DataFrame:
    """F8: the optional stages in their order, on validated input."""
    need(df, *keys, "ts", "available_at", "open", "high", "low", "close", "volume")
    steps = {
        "returns": lambda d: I.add_returns(d, keys=keys),
        "volatility": lambda d: I.add_volatility(d, keys=keys),
        "trend": lambda d: add_trend(d, keys),
        "bands": lambda d: I.add_reclaims(I.add_bands(d, keys=keys), keys=keys),
        "momentum": lambda d: I.add_momentum(I.add_rsi(d, keys=keys), keys=keys),
        "volume": lambda d: I.add_volume(d, keys=keys),
        "derivatives": lambda d: add_derivatives(d, keys),
        "forced_flow": lambda d: add_forced_flow(d, keys=keys),
        "regimes": lambda d: add_regimes(d, keys),
    }
    for name in STAGES:
        if name in stages:
            df = steps[name](df)
    return no_future(df)


def causality_report(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows whose value was not available yet, for each derivative column there is."""
    pairs = [(v, a) for v, a in (("funding_rate", "funding_available_at"), ("open_interest", "oi_available_at"), ("basis", "basis_available_at")) if v in df.columns and a in df.columns]
    return df.groupBy(*keys).agg(*(F.count_if(F.col(v).isNotNull() & (F.col(a) > F.col("available_at"))).alias(f"n_late_{v}") for v, a in pairs))


def quality_report(df: DataFrame, features: list[str], warmup: int = 120, keys=KEYS) -> DataFrame:
    """Nulls of each feature, and its coverage after the warm-up rows."""
    df = df.withColumn("_n", F.row_number().over(I.by_time(keys)))
    late = F.when(F.col("_n") > warmup, 1)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(f).isNull()).alias(f"nulls_{f}") for f in features), *(F.avg(F.when(late.isNotNull(), F.col(f).isNotNull().cast("double"))).alias(f"coverage_{f}") for f in features))
