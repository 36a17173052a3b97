"""As-of joins: the latest right row at or before each left row, by union and a running last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, every


def asof(left: DataFrame, right: DataFrame, keys=KEYS, on: str = "ts", right_on: str | None = None, ties=(), prefix: str = "", hours: int | None = None) -> DataFrame:
    """Left with the right columns of the last right row of the key with time <= left's; right's time as context_ts.

    Equal times match, and of several right rows the last by `ties` wins. right_on: right's time column, `on` by default.
    hours: cut each key's history into blocks of that many hours and carry the last right row into the next blocks, for
    few keys with long histories; the rows are the same.
    """
    values = [c for c in right.columns if c not in keys and c != (right_on or on)]
    r = right.select(*keys, F.col(right_on or on).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_on or on).alias("context_ts"), *(F.col(c).alias(f"{prefix}{c}") for c in values)).alias("_r"), F.struct(*(F.col(c) for c in ties), F.lit(0)).alias("_tie"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    empty = r.schema["_r"].dataType, r.schema["_tie"].dataType
    l = left.select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(empty[0]).alias("_r"), F.lit(None).cast(empty[1]).alias("_tie"), F.struct(*(F.col(c) for c in left.columns)).alias("_l"))
    both = r.unionByName(l)
    order = ["_t", "_side", "_tie"]
    if hours is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_block", F.floor(F.unix_timestamp("_t") / (3600 * hours)))
        w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ends = both.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie", "_r"))).alias("_end"))
        carry = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(carry).alias("_carry"))
        found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).join(ends, [*keys, "_block"]).withColumn("_r", F.coalesce("_r", F.col("_carry._r")))
    return found.where("_side = 1").select("_l.*", "_r.*")


def no_leak(joined: DataFrame, keys=KEYS, on: str = "ts") -> DataFrame:
    """Joined rows, matched rows and rows whose context is later than they are, by key."""
    return joined.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("context_ts").alias("n_matched"), F.count_if(F.col("context_ts") > F.col(on)).alias("n_future"))


def gate(signals: DataFrame, context: DataFrame, max_spread: float | None = None, depth: tuple[float | None, float | None] = (-1.0, 1.0), suppress_missing: bool = True, keys=KEYS) -> DataFrame:
    """Entries (signal 1) whose context fails are nulled; all other signals pass.

    spread_bps and depth_imbalance are tested where the context has them, the depth within its bounds, ends included. Where
    one of them is missing an entry fails, or without suppress_missing passes, whatever the other is.
    """
    out = asof(signals, context, keys)
    low, high = (-1.0 if depth[0] is None else depth[0]), (1.0 if depth[1] is None else depth[1])
    tests = {"spread_bps": F.lit(True) if max_spread is None else F.col("spread_bps") <= max_spread, "depth_imbalance": F.col("depth_imbalance").between(low, high)}
    there = [n for n in tests if n in context.columns]
    ok = F.lit(True)
    if there:
        available, passed = every(*(F.col(n).isNotNull() for n in there)), every(*(tests[n] for n in there))
        ok = F.when(available, passed).otherwise(not suppress_missing)
    passes = F.when(F.col("raw_signal") == 1, F.coalesce(ok, F.lit(False))).otherwise(True)
    out = out.withColumn("raw_signal", F.col("signal")).withColumn("context_gate_pass", passes)
    return out.withColumn("signal", F.when(F.col("context_gate_pass"), F.col("raw_signal")))


def forecast_signal(bars: DataFrame, forecasts: DataFrame, threshold: float = 0.0, keys=KEYS) -> DataFrame:
    """Bars with their forecast (0 where there is none) and the signal it gives."""
    out = bars.join(forecasts, [*keys, "ts"], "left").withColumn("prediction_value", F.coalesce("prediction_value", F.lit(0.0)))
    return out.withColumn("signal", (F.col("prediction_value") > threshold).cast("int"))


def aligned(bars: DataFrame, symbols: int, keys=KEYS) -> DataFrame:
    """Rows of the times at which all `symbols` have a bar."""
    full = bars.groupBy("ts").agg(F.count_distinct(*keys).alias("_n")).where(F.col("_n") == symbols).select("ts")
    return bars.join(full, "ts", "left_semi")


def snapshots(events: DataFrame, probes: DataFrame, types: list[str]) -> DataFrame:
    """J8 for many probes of long histories: one as-of join for each type instead of a range join."""
    good = events.where("historical_integrity")
    out = probes
    for t in types:
        one = good.where(F.col("signal_type") == t).select("symbol", "ts", F.col("value").alias(t))
        out = asof(out, one).drop("context_ts")
    return out
