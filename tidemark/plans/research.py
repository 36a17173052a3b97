"""Segments, sweeps, labels, scores and verdicts: every run is a key of one plan, never a loop of runs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEYS, TINY, before, by_time, rolling, safe_div
from ..operators import stretches as ST
from ..operators.asof import gate
from ..operators.blocks import first_touch, in_blocks
from ..operators.scan import with_halo
from . import ledger as B
from . import metrics as A
from .signals import RsiParams, add_rsi_signal, rsi_momentum, rsi_signal, trend_filtered


def date_segments(df: DataFrame, train_start: str, train_end: str, test_end: str) -> DataFrame:
    """Role train in [start, end), test from then to test_end inclusive; other rows go."""
    t = F.col("ts")
    a, b, c = (F.to_timestamp(F.lit(x)) for x in (train_start, train_end, test_end))
    return df.withColumn("role", F.when((t >= a) & (t < b), "train").when((t >= b) & (t <= c), "test")).where("role IS NOT NULL")


def walk_forward(df: DataFrame, train: int, test: int, step: int, keys=KEYS) -> DataFrame:
    """R2: a copy of each bar for each fold and role it is in; folds that the history doesn't fill are dropped."""
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    df = df.withColumns({"_i": F.row_number().over(by_time(keys)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    i, folds = F.col("_i"), F.floor((F.col("_n") - (train + test)) / step)  # the last fold that is full
    low = F.greatest(F.lit(0), F.ceil((i - (train + test) + 1) / step))
    high = F.least(folds, F.floor(i / step))
    df = df.withColumn("fold", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("role", F.when(F.col("_i") - F.col("fold") * step < train, "train").otherwise("test"))
    return df.drop("_i", "_n")


def fold_metrics(ledger: DataFrame, train: int, test: int, step: int, keys=KEYS, seconds: int = ST.WEEK) -> DataFrame:
    """Rows, times, return, drawdown, exposure, turnover and longest losing streak of every fold and role of a finished ledger.

    Bars aren't copied into folds. They are summed up once into cells of the greatest length that divides train, test and
    step; a fold's part is its cells put together in order. A cell is (product, peak, low, worst drawdown; losing bars at its
    start, at its end, most in a row).
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    g = math.gcd(train, test, step)
    df = ST.numbered(ledger, "_number", keys, seconds).withColumn("_c", F.floor((F.col("_number") - 1) / g))
    cell = Window.partitionBy(*keys, "_c").orderBy("ts")
    so_far = cell.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_p": F.product(1 + F.col("net_return")).over(so_far), "_loss": F.coalesce(F.col("net_return") < 0, F.lit(False)), "_at": F.row_number().over(cell)})
    # the row of the last gain tells how many losses have come in a row since
    df = df.withColumns({"_m": F.max("_p").over(so_far), "_since": F.col("_at") - F.coalesce(F.max(F.when(~F.col("_loss"), F.col("_at"))).over(so_far), F.lit(0))})
    cells = df.groupBy(*keys, "_c").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("_p", "_at").alias("product"), F.max("_p").alias("peak"), F.min("_p").alias("low"), F.min(safe_div(F.col("_p"), F.col("_m")) - 1).alias("worst"),
        F.sum(F.col("is_exposed").cast("long")).alias("exposed"), F.sum("turnover").alias("turnover"), F.coalesce(F.min(F.when(~F.col("_loss"), F.col("_at"))) - 1, F.count("*")).alias("head"), F.max_by("_since", "_at").alias("tail"), F.max("_since").alias("most"),
    )
    total = cells.groupBy(*keys).agg(F.sum("n").alias("_n"))
    c, a, b, s = F.col("_c"), train // g, test // g, step // g
    folds = F.floor((F.col("_n") - (train + test)) / step)
    low, high = F.greatest(F.lit(0), F.ceil((c - (a + b) + 1) / s)), F.least(folds, F.floor(c / s))
    placed = cells.join(total, list(keys)).withColumn("fold", F.explode(F.when(high >= low, F.sequence(low, high))))
    placed = placed.withColumn("role", F.when(c - F.col("fold") * s < a, "train").otherwise("test"))
    parts = placed.groupBy(*keys, "fold", "role").agg(
        F.array_sort(F.collect_list(F.struct("_c", "n", "product", "peak", "low", "worst", "head", "tail", "most"))).alias("_cells"), F.sum("n").alias("n_rows"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), F.sum("exposed").alias("_exposed"), F.sum("turnover").alias("turnover"),
    )

    def put(x: Column, y: Column) -> Column:
        high = F.greatest(x["peak"], x["product"] * y["peak"])
        worst = F.least(x["worst"], y["worst"], F.when(x["peak"] > 0, x["product"] * y["low"] / x["peak"] - 1))
        return F.struct(
            (x["product"] * y["product"]).alias("product"), high.alias("peak"), worst.alias("worst"),
            F.greatest(x["most"], y["most"], x["tail"] + y["head"]).alias("most"), F.when(y["tail"] == y["n"], x["tail"] + y["tail"]).otherwise(y["tail"]).alias("tail"),
        )

    nothing = F.struct(F.lit(1.0).alias("product"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"), F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("tail"))
    done = parts.withColumn("_all", F.aggregate("_cells", nothing, put))
    return done.select(*keys, "fold", "role", "n_rows", "first_ts", "last_ts", (F.col("_all.product") - 1).alias("total_return"), F.col("_all.worst").alias("max_drawdown"), (F.col("_exposed") / F.col("n_rows")).alias("exposure"), "turnover", F.col("_all.most").alias("losing_bars"))


def ratio_split(df: DataFrame, shares: dict[str, float], keys=KEYS) -> DataFrame:
    """Roles by the share of each key's rows, in order of time."""
    place = F.row_number().over(by_time(keys)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    df = df.withColumns({"_i": place, "_n": n})
    role, total = None, 0.0
    for name, share in shares.items():
        total += share
        inside = F.col("_i") < F.floor(F.col("_n") * round(total, 9) + 1e-9)
        role = F.when(inside, name) if role is None else role.when(inside, name)
    return df.withColumn("role", role).where("role IS NOT NULL").drop("_i", "_n")


def manifest(df: DataFrame, *by: str) -> DataFrame:
    """Rows and times of each segment."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def labels(df: DataFrame, profit: float = 0.01, stop: float = 0.01, horizon: int = 5, keys=KEYS, side: Column | None = None, length: int = 4096) -> DataFrame:
    """Which barrier is touched first in the next `horizon` bars: 1 profit (also on a tie), -1 stop, else the sign of the return at the end.

    side: over 0, 0 or null long, under 0 short, whose return is entry / exit - 1. label_time, label_price, label_return,
    label_bars and barrier_hit (profit_take, stop_loss, time) go with it; a history's last bar ends on itself. Bars without
    a close have no label, and those without a high or low touch nothing. Touches are found by descent in blocks with the
    next `horizon` rows, so neither arrays nor join rows grow with the horizon.
    """
    if min(profit, stop, horizon) <= 0:
        raise ValueError("profit, stop and horizon must be positive")

    def work(table: pa.Table) -> dict[str, pa.Array]:
        close, high, low, way = (table[c].cast(pa.float64()).to_numpy() for c in ("close", "high", "low", "_side"))
        n, short = len(close), way < 0
        top, bottom = np.where(short, close * (1.0 + stop), close * (1.0 + profit)), np.where(short, close * (1.0 - profit), close * (1.0 - stop))
        high, low = np.where(np.isnan(high), -np.inf, high), np.where(np.isnan(low), np.inf, low)
        row = np.arange(n)
        end = np.minimum(row + horizon, n - 1)
        at = first_touch(high, low, top, bottom, horizon)
        touched = at <= end
        at = np.where(touched, at, end)
        won = touched & np.where(short, low[at] <= bottom, high[at] >= top)
        lost = touched & ~won
        price = np.where(won, np.where(short, bottom, top), np.where(lost, np.where(short, top, bottom), close[at]))
        move = np.where(short, close / price - 1.0, price / close - 1.0)
        label = np.where(won, 1, np.where(lost, -1, np.sign(np.nan_to_num(move)))).astype(np.int32)
        none = np.isnan(close) | np.isnan(price)
        hit = np.where(won, "profit_take", np.where(lost, "stop_loss", "time"))
        return {
            "label": pa.array(label, mask=none), "label_time": pc.if_else(pa.array(none), None, table["ts"].combine_chunks().take(pa.array(at))), "label_price": pa.array(price, mask=none),
            "label_return": pa.array(move, mask=none), "label_bars": pa.array((at - row).astype(np.int32), mask=none), "barrier_hit": pa.array(hit, pa.string(), mask=none),
        }

    df = df.withColumn("_side", F.coalesce((F.lit(1.0) if side is None else side).cast("double"), F.lit(1.0)))
    return in_blocks(df, work, "label int, label_time timestamp, label_price double, label_return double, label_bars int, barrier_hit string", ahead=horizon, keys=keys, length=length).drop("_side")


def grid(spark: SparkSession, periods, uppers, lowers, exits, fees=(0.0,), slippages=(0.0,)) -> DataFrame:
    """The grid's combinations that keep lower < exit < upper, numbered by their values."""
    values = {"rsi_period": periods, "rsi_upper": uppers, "rsi_lower": lowers, "rsi_exit": exits, "fee_bps": fees, "slippage_bps": slippages}
    df = spark.range(1).select(*(F.array(*(F.lit(v).cast("int" if k == "rsi_period" else "double") for v in vs)).alias(k) for k, vs in values.items()))
    for k in values:
        df = df.withColumn(k, F.explode(k))
    df = df.where("rsi_lower < rsi_exit AND rsi_exit < rsi_upper")
    return df.withColumn("param_id", F.concat_ws("/", *(F.format_string("%.1f", F.col(k).cast("double")) for k in values)))


def fingerprints(params: DataFrame) -> DataFrame:
    """One row for each set of values, whatever its name."""
    names = sorted(c for c in params.columns if c != "param_id")
    return params.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*names)), 256)).dropDuplicates(["fingerprint"])


@dataclass(frozen=True)
class Thresholds:
    """RSI thresholds that are columns of a params table."""

    upper: Column
    lower: Column
    exit: Column


def sweep(bars: DataFrame, params: DataFrame, periods: list[int], keys=KEYS, variant: str = "neutral-exit", long_only: bool = True) -> DataFrame:
    """Ledgers of every symbol and parameter set in one plan, keyed by (keys, param_id).

    An RSI column is made once for each distinct period, then the params meet the bars on the period. The grid is a few
    hundred rows made from literals, so it is broadcast.
    """
    for n in periods:
        bars = I.add_rsi(bars, n, keys, flat=100.0, name=f"_rsi_{n}")
    stacked = bars.select(*keys, "ts", "close", F.explode(F.array(*(F.struct(F.lit(n).alias("rsi_period"), F.col(f"_rsi_{n}").alias("rsi")) for n in periods))).alias("_x")).select(*keys, "ts", "close", "_x.rsi_period", "_x.rsi")
    runs = stacked.join(F.broadcast(params), "rsi_period")
    k = (*keys, "param_id")
    runs = runs.withColumn("signal", rsi_signal(variant, F.col("rsi"), Thresholds(F.col("rsi_upper"), F.col("rsi_lower"), F.col("rsi_exit")), k))
    return B.ledger(runs, B.cost_rate(F.col("fee_bps"), F.col("slippage_bps")), keys=k, long_only=long_only)


def sweep_in_stretches(bars: DataFrame, params: DataFrame, periods: list[int], keys=KEYS, variant: str = "neutral-exit", long_only: bool = True, seconds: int = ST.WEEK) -> DataFrame:
    """The rows of sweep(), and their drawdown, without a window over a whole history: RSI by blocks with a halo, then every
    parameter set's signal held and its equity scanned in stretches, all sets in one plan."""

    def indicators(df: DataFrame, k) -> DataFrame:
        for n in periods:
            df = I.add_rsi(df, n, k, flat=100.0, name=f"_rsi_{n}")
        return df

    bars = with_halo(bars, indicators, max(periods), keys)
    stacked = bars.select(*keys, "ts", "close", F.explode(F.array(*(F.struct(F.lit(n).alias("rsi_period"), F.col(f"_rsi_{n}").alias("rsi")) for n in periods))).alias("_x")).select(*keys, "ts", "close", "_x.rsi_period", "_x.rsi")
    k = (*keys, "param_id")
    runs = stacked.join(F.broadcast(params), "rsi_period")
    runs = add_rsi_signal(runs, variant, F.col("rsi"), Thresholds(F.col("rsi_upper"), F.col("rsi_lower"), F.col("rsi_exit")), k, seconds=seconds)
    return B.ledger_in_stretches(runs, B.cost_rate(F.col("fee_bps"), F.col("slippage_bps")), keys=k, long_only=long_only, seconds=seconds)


def top(results: DataFrame, n: int, by: str = "cumulative_return") -> DataFrame:
    """The best n; a run without a value counts as failed and stands last."""
    return results.orderBy(F.desc_nulls_last(by), *[c for c in ("symbol", "param_id") if c in results.columns]).limit(n)


def objective(metrics: DataFrame, train: DataFrame | None = None, keys=("symbol", "param_id")) -> DataFrame:
    """Sharpe + return / 2 + Calmar / 5, less penalties for a loss, a deep drawdown and a gap to training."""
    ret, dd = F.col("cumulative_return"), F.col("max_drawdown")
    penalty = F.when(ret < 0, 5.0).otherwise(0.0) + F.when(dd < -0.25, 2.0).otherwise(0.0)
    if train is not None:
        metrics = metrics.join(train.select(*keys, F.col("cumulative_return").alias("_train")), list(keys))
        penalty = penalty + F.when(F.col("_train") > ret * 2, 1.0).otherwise(0.0)
    calmar = F.coalesce(F.abs(safe_div(ret, dd)), F.lit(0.0))
    return metrics.withColumn("objective", F.col("smart_sharpe") + ret * 0.5 + calmar * 0.2 - penalty).drop("_train")


def champions(scored: DataFrame, keys=KEYS) -> DataFrame:
    """The best parameter set of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("objective"), "param_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Two runs of the same positions differ by less: that is no improvement.
ROUNDING = 1e-9


def split_runs(bars: DataFrame, params: RsiParams = RsiParams(), train: float = 0.6, cost_bps: float = 6.0, high_cost_bps: float = 15.0, keys=KEYS) -> DataFrame:
    """Ledgers of the runs train, test, hold (the test bars bought and held) and cost (the test bars at high cost), each from nothing, in one plan."""
    split = ratio_split(bars, {"train": train, "test": 1 - train}, keys)
    runs = F.when(F.col("role") == "train", F.array(F.lit("train"))).otherwise(F.array(F.lit("test"), F.lit("hold"), F.lit("cost")))
    df, k = split.withColumn("run", F.explode(runs)).drop("role"), (*keys, "run")
    df = I.add_rsi(df, params.period, k, flat=100.0, name="rsi")
    df = df.withColumn("signal", F.when(F.col("run") == "hold", 1).otherwise(rsi_signal("neutral-exit", F.col("rsi"), params, k)))
    return B.ledger(df, F.when(F.col("run") == "cost", high_cost_bps / 1e4).otherwise(cost_bps / 1e4), keys=k)


def window_returns(bars: DataFrame, params: RsiParams, train: int, test: int, step: int, cost_bps: float = 6.0, keys=KEYS) -> DataFrame:
    """The return of each fold's test bars, from nothing: by (keys, fold)."""
    df, k = walk_forward(bars, train, test, step, keys).where("role = 'test'"), (*keys, "fold")
    df = I.add_rsi(df, params.period, k, flat=100.0, name="rsi")
    return total_returns(B.ledger(df.withColumn("signal", rsi_signal("neutral-exit", F.col("rsi"), params, k)), F.lit(cost_bps / 1e4), keys=k), k)


def total_returns(ledger: DataFrame, keys) -> DataFrame:
    """cumulative_return of each key's ledger."""
    return ledger.groupBy(*keys).agg((F.max_by("equity", "ts") - 1).alias("cumulative_return"))


def _runs_side_by_side(metrics: DataFrame, wanted: dict[str, tuple[str, str]], keys) -> DataFrame:
    """One row for each key: columns named as in `wanted`, (run, metric)."""
    return metrics.groupBy(*keys).agg(*(F.max(F.when(F.col("run") == run, F.col(metric))).alias(n) for n, (run, metric) in wanted.items()))


def _share_of_gains(metrics: DataFrame, name: str, keys) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg((F.col("cumulative_return") > 0).cast("double")).alias(name))


def robustness(runs: DataFrame, windows: DataFrame, sweep: DataFrame, keys=KEYS) -> DataFrame:
    """Six tests, their number, and a class.

    runs: metrics by (keys, run) of split_runs(); windows: of window_returns(); sweep: of parameter sets on the test bars. The
    test bars must beat buying and holding in Sharpe ratio and in drawdown and gain, half of the windows and seven tenths of
    the sets must gain, and the high cost must leave a gain. Without windows or sets theirs count as passed.
    """
    wanted = {"_s": ("test", "smart_sharpe"), "_hs": ("hold", "smart_sharpe"), "_d": ("test", "max_drawdown"), "_hd": ("hold", "max_drawdown"), "_r": ("test", "cumulative_return"), "_c": ("cost", "cumulative_return")}
    out = _runs_side_by_side(runs, wanted, keys).join(_share_of_gains(windows, "_w", keys), list(keys), "left").join(_share_of_gains(sweep, "_p", keys), list(keys), "left")
    tests = {
        "sharpe_over_hold": F.col("_s") > F.col("_hs"), "drawdown_over_hold": F.col("_d") > F.col("_hd"), "positive_return": F.col("_r") > 0, "profitable_windows": F.coalesce("_w", F.lit(1.0)) >= 0.5,
        "broad_neighbourhood": F.coalesce("_p", F.lit(1.0)) >= 0.7, "positive_at_high_cost": F.col("_c") > 0,
    }
    reasons = F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    score = F.size("reasons")
    out = out.withColumn("reasons", reasons).withColumn("robustness_score", score)
    return out.select(*keys, "robustness_score", F.when(score >= 5, "robust").when(score >= 3, "promising_but_needs_filters").otherwise("rejected").alias("robustness_class"), "reasons")


def filter_scores(metrics: DataFrame, champion: str = "unfiltered_champion", keys=KEYS, kind: str = "filter_id", synthetic: tuple[str, ...] = ()) -> DataFrame:
    """Each context filter's score against the unfiltered champion of its key, its class, and whether it is the best of the others.

    Needs smart_sharpe, max_drawdown and retention. synthetic: filters whose context isn't real data.
    """
    base = metrics.where(F.col(kind) == champion).select(*keys, F.col("smart_sharpe").alias("_s"), F.col("max_drawdown").alias("_d"))
    one = lambda c: F.when(c, 1).otherwise(0)
    score = one(F.col("smart_sharpe") > F.col("_s") + ROUNDING) + one(F.col("max_drawdown") > F.col("_d") + ROUNDING) + F.when(F.col("retention") >= 0.4, 1).otherwise(-1)
    out = metrics.join(base, list(keys)).withColumn("score", score).drop("_s", "_d")
    grade = F.when(F.col(kind).isin(*synthetic), "promising_but_needs_real_context_data").when(F.col("score") >= 2, "accept_filter_candidate").when(F.col("score") >= 0, "keep_unfiltered_champion").otherwise("reject_filter")
    w = Window.partitionBy(*keys).orderBy((F.col(kind) == champion).cast("int"), F.desc("score"), kind)
    return out.withColumns({"classification": grade, "selected": (F.row_number().over(w) == 1) & (F.col(kind) != champion)})


def chop_scores(metrics: DataFrame, baseline: str = "none", kind: str = "filter_id") -> DataFrame:
    """Chop filters scored on the means over symbols of their whole, earlier and later periods; the best is selected if it scores at all.

    Needs a row for each symbol, filter and period (full, pre, post) with smart_sharpe, max_drawdown and turnover.
    """
    of = lambda period, x: F.avg(F.when(F.col("period") == period, F.col(x)))
    m = metrics.groupBy(kind).agg(of("full", "smart_sharpe").alias("full_sharpe"), of("pre", "smart_sharpe").alias("pre_sharpe"), of("post", "smart_sharpe").alias("post_sharpe"), of("post", "max_drawdown").alias("post_mdd"), of("post", "turnover").alias("post_turnover"))
    base = m.where(F.col(kind) == baseline).select(*(F.col(c).alias(f"_{c}") for c in m.columns if c != kind))
    one = lambda c: F.when(c, 1).otherwise(0)
    score = one(F.col("post_mdd") > F.col("_post_mdd") + ROUNDING) + one(F.col("post_turnover") < F.col("_post_turnover") * 0.85 - ROUNDING) + one(F.col("full_sharpe") >= F.col("_full_sharpe") - ROUNDING) + one(F.col("pre_sharpe") >= F.col("_pre_sharpe") * 0.95 - ROUNDING)
    out = m.join(F.broadcast(base)).withColumn("score", F.when(F.col(kind) != baseline, score).otherwise(0))  # the baseline is one row
    # one row a filter: the best by score, a candidate before the baseline only if it scores
    w = Window.orderBy(F.desc("score"), (F.col(kind) != baseline).cast("int"), kind)
    return out.select(kind, *(c for c in m.columns if c != kind), "score", (F.row_number().over(w) == 1).alias("selected"))


def generalisation(filtered: DataFrame, unfiltered: DataFrame, keys=KEYS) -> DataFrame:
    """Over all symbols, one point for each that gains and one for each whose Sharpe ratio the filter improves; and a class."""
    both = filtered.join(unfiltered.select(*keys, F.col("smart_sharpe").alias("_s")), list(keys))
    points = F.when(F.col("cumulative_return") > 0, 1).otherwise(0) + F.when(F.col("smart_sharpe") > F.col("_s") + ROUNDING, 1).otherwise(0)
    out = both.agg(F.coalesce(F.sum(points), F.lit(0)).alias("score"), F.avg("smart_sharpe").alias("average_sharpe"))
    return out.withColumn("classification", F.when(F.col("score") >= 4, "generalizes").when(F.col("score") <= 1, "btc_only").otherwise("promising_but_mixed"))


#: Weights of the objective's parts, and what a candidate must keep.
WEIGHTS = {"oos_sharpe": 3.0, "profit_factor": 2.0, "walk_forward_pass_rate": 2.0, "max_drawdown": 3.0, "max_daily_drawdown": 2.0, "turnover": 1.0, "trade_count": 2.0, "is_oos_gap": 2.0, "oos_return": 2.0}


@dataclass(frozen=True)
class Criteria:
    min_trades: int = 20
    min_oos_sharpe: float = 0.0
    max_drawdown: float = 0.16
    max_gap: float = 0.5
    min_pass_rate: float = 0.0
    max_turnover: float = 1.0
    min_profit_factor: float = 0.0
    max_daily_drawdown: float = 0.08
    positive_return: bool = True


def multi_objective(metrics: DataFrame, criteria: Criteria = Criteria(), weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted parts less penalties, and what failed.

    Needs smart_sharpe (out of sample), is_sharpe, max_drawdown, max_daily_drawdown, turnover, trade_count, profit_factor,
    walk_forward_pass_rate, cumulative_return and validation_passed; what is missing counts as 0, a missing is_sharpe as the other.
    """
    w, c = WEIGHTS | (weights or {}), criteria
    number = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    over = lambda x: F.greatest(x, F.lit(0.0))
    sharpe, ret, pf, rate, turnover, trades = (number(n) for n in ("smart_sharpe", "cumulative_return", "profit_factor", "walk_forward_pass_rate", "turnover", "trade_count"))
    dd, daily = F.abs(number("max_drawdown")), F.abs(number("max_daily_drawdown"))
    gap = F.abs(F.coalesce(F.col("is_sharpe"), sharpe) - sharpe)
    parts = sharpe * w["oos_sharpe"] + over(pf) * w["profit_factor"] + rate * w["walk_forward_pass_rate"]
    penalties = (
        over(dd - c.max_drawdown) * w["max_drawdown"] + over(daily - c.max_daily_drawdown) * w["max_daily_drawdown"] + over(turnover - c.max_turnover) * w["turnover"]
        + over(c.min_trades - trades) * w["trade_count"] + over(gap - c.max_gap) * w["is_oos_gap"] + F.when(ret <= 0, w["oos_return"]).otherwise(0.0)
    )
    failed = {
        "low_trade_count": trades < c.min_trades, "max_drawdown_exceeded": dd > c.max_drawdown, "oos_sharpe_below_minimum": sharpe < c.min_oos_sharpe, "is_oos_sharpe_gap_too_large": gap > c.max_gap,
        "walk_forward_pass_rate_too_low": rate < c.min_pass_rate, "turnover_too_high": turnover > c.max_turnover, "profit_factor_too_low": pf < c.min_profit_factor, "max_daily_drawdown_exceeded": daily > c.max_daily_drawdown,
        "oos_return_not_positive": (ret <= 0) & F.lit(c.positive_return), "deterministic_validation_failed": ~F.coalesce("validation_passed", F.lit(False)),
    }
    out = metrics.withColumns({"score": parts - penalties, "failures": F.array_compact(F.array(*(F.when(t, n) for n, t in failed.items())))})
    return out.withColumn("passed", F.size("failures") == 0)


def verdicts(both: DataFrame) -> DataFrame:
    """Columns base_x and ctx_x for return, drawdown, sharpe, trades, exposure and quality; verdict and warnings."""
    b, c = (lambda x: F.col(f"base_{x}")), (lambda x: F.col(f"ctx_{x}"))
    verdict = (
        F.when((c("return") > b("return")) & (F.abs(c("drawdown")) < F.abs(b("drawdown"))), "improved")
        .when((c("trades") < b("trades")) & (c("sharpe") > b("sharpe")), "promising")
        .when((c("exposure") < b("exposure")) & (c("quality") <= b("quality")), "inconclusive")
        .when((c("return") < b("return")) & (c("sharpe") <= b("sharpe")), "reject")
        .otherwise("inconclusive")
    )
    warnings = F.array_compact(F.array(F.when(c("trades") == 0, "no context trades"), F.when(b("trades") == 0, "no baseline trades"), F.when(c("exposure") < 0.01, "no exposure"), F.when(c("return") == b("return"), "same return")))
    return both.withColumns({"verdict": verdict, "warnings": warnings})


def experiment(segments: DataFrame, context_ok: Column, params: RsiParams = RsiParams(), cost_bps: float = 6.0, keys=("symbol", "fold", "role")) -> DataFrame:
    """Baseline and context mode of every segment in one plan; metrics, trades and exposure by (symbol, fold, role, mode).

    Indicators and positions start anew in each segment.
    """
    df = I.add_rsi(segments, params.period, keys, flat=100.0, name="rsi")
    df = df.withColumn("mode", F.explode(F.array(F.lit("baseline"), F.lit("context"))))
    k = (*keys, "mode")
    plain = F.when(F.col("rsi") >= params.upper, 1).when(F.col("rsi") < params.exit, 0)
    df = df.withColumn("signal", F.when((F.col("mode") == "context") & (plain == 1) & ~F.coalesce(context_ok, F.lit(False)), None).otherwise(plain))
    led = B.ledger(df, F.lit(cost_bps / 1e4), keys=k)
    out = A.metrics(led, keys=k).join(A.trade_metrics(B.trade_returns(led, k), led, k), list(k))
    return out


def compare_modes(results: DataFrame, keys=("symbol", "fold")) -> DataFrame:
    """Test segments' modes side by side with their verdict."""
    quality = F.col("win_rate") + F.coalesce("profit_factor", F.lit(0.0))
    names = {"return": F.col("cumulative_return"), "drawdown": F.col("max_drawdown"), "sharpe": F.col("smart_sharpe"), "trades": F.col("trade_count"), "exposure": F.col("exposure"), "quality": quality}
    sides = [F.max(F.when(F.col("mode") == mode, x)).alias(f"{p}_{n}") for mode, p in (("baseline", "base"), ("context", "ctx")) for n, x in names.items()]
    return verdicts(results.where("role = 'test'").groupBy(*keys).agg(*sides))


def acceptance(signals: DataFrame, context: DataFrame, max_spread: float, cost_bps: float = 6.0, keys=KEYS) -> DataFrame:
    """Baseline and gated candidate keyed by `label`, with the invariants of both: the one-bar lag and no context of the future."""
    gated = gate(signals, context, max_spread=max_spread, keys=keys)
    both = F.explode(F.array(F.struct(F.lit("baseline").alias("label"), F.col("raw_signal").alias("s")), F.struct(F.lit("candidate").alias("label"), F.col("signal").alias("s")))).alias("_x")
    rows = gated.select(*keys, "ts", "close", "context_ts", both).select(*keys, "ts", "close", "context_ts", "_x.label", F.col("_x.s").alias("signal"))
    k = (*keys, "label")
    led = B.ledger(rows, F.lit(cost_bps / 1e4), keys=k)
    led = led.withColumn("_lag", F.coalesce(before(F.col("target_position"), 1, k), F.lit(0.0)))
    return led.groupBy(*k).agg(F.count_if(F.col("signal") == 1).alias("n_entries"), (F.max_by("equity", "ts") - 1).alias("total_return"), F.sum("turnover").alias("turnover"), F.count_if(~F.col("position").eqNullSafe(F.col("_lag"))).alias("lag_violations"), F.count_if(F.col("context_ts") > F.col("ts")).alias("future_violations"))


def lag_violations(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """Bars whose position isn't the target of the bar before."""
    df = ledger.withColumn("_lag", F.coalesce(before(F.col("target_position"), 1, keys), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.count_if(~F.col("position").eqNullSafe(F.col("_lag"))).alias("lag_violations"))


def high_vol_disabled(df: DataFrame, most: float = 2.5, n: int = 42, keys=KEYS) -> DataFrame:
    """The signal, 0 while realised volatility is over `most` deviations from its mean; what isn't known yet counts as 0 deviations."""
    df = df.withColumn("_ret", I.returns(F.col("close"), 1, keys)).withColumn("_vol", rolling(F.stddev_samp, F.col("_ret"), n, keys))
    mean, dev = rolling(F.avg, F.col("_vol"), n, keys, 1), rolling(F.stddev_samp, F.col("_vol"), n, keys, 1)
    z = F.coalesce(safe_div(F.col("_vol") - mean, F.when(dev >= TINY, dev)), F.lit(0.0))
    return df.withColumn("signal", F.when(z <= most, F.col("signal")).otherwise(0)).drop("_ret", "_vol")


def forward_validation(bars: DataFrame, start: str, holdout: tuple[str, ...], params: RsiParams = RsiParams(), cost_bps: float = 6.0, least: int = 10, keys=KEYS) -> DataFrame:
    """Return, Sharpe ratio and drawdown by (keys, sample, arm).

    sample: `holdout` for those symbols' whole histories, `forward` for the others' bars from `start` on, which begin from
    nothing and need `least` of them. arm: `baseline` is RSI momentum with the trend filter, `enhanced` also without high volatility.
    """
    held = F.col("symbol").isin(*holdout)
    df = bars.withColumn("sample", F.when(held, "holdout").otherwise("forward")).where(held | (F.col("ts") >= F.to_timestamp(F.lit(start))))
    k = (*keys, "sample")
    enough = df.groupBy(*k).agg(F.count("*").alias("_n")).where((F.col("_n") >= least) | (F.col("sample") == "holdout")).select(*k)
    df = rsi_momentum(df.join(enough, list(k), "left_semi"), params, keys=k)
    base = trend_filtered(df, keys=k)
    both = base.withColumn("arm", F.lit("baseline")).unionByName(high_vol_disabled(base, keys=k).withColumn("arm", F.lit("enhanced")))
    led = B.ledger(both, F.lit(cost_bps / 1e4), keys=(*k, "arm"))
    return A.bar_metrics(led, "net_return", (*k, "arm")).drop("annualized_vol")


def as_json(params: RsiParams) -> str:
    return json.dumps(params.__dict__, sort_keys=True)

