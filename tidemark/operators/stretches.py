"""Scans of whole histories in stretches of time, so that one long symbol is many tasks.

A stretch is a span of `seconds` of one key. Inside it a running value is a
window by (key, stretch); the stretch as a whole is one row that says what it
does to whatever comes in; those rows are folded in order of time, and a join
brings each stretch what comes into it. Three scans are built on this:

  held      the last signal so far. Each row maps the state before it to the
            state after: to its own signal, or to itself where it has none. Such
            maps compose to the last signal of a stretch, or to the identity.
  equity    product, peak and worst drawdown of 1 + return: of two parts a, b
            the product is a.product * b.product, the peak max(a.peak,
            a.product * b.peak), and the worst drawdown min(a.worst, b.worst,
            a.product * b.low / a.peak - 1).
  runs      runs of equal state. Those that touch neither end of a stretch are
            whole; of the others there are two a stretch at most, and neighbours
            of one state are put together.

Folds go over one row a stretch and key (runs: two). Keys and times have no
nulls; a key has one row for each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import KEYS, safe_div

WEEK = 7 * 86400


def with_stretch(df: DataFrame, seconds: int = WEEK, time: str = "ts") -> DataFrame:
    """_s: the number of the stretch that the row is in."""
    return df.withColumn("_s", F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds))


def inside(keys=KEYS, time: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys, "_s").orderBy(time)


def inside_so_far(keys=KEYS, time: str = "ts") -> WindowSpec:
    return inside(keys, time).rowsBetween(Window.unboundedPreceding, 0)


def carried(df: DataFrame, sums: dict[str, Column], *folds: Callable[[WindowSpec, WindowSpec], dict[str, Column]], keys=KEYS) -> DataFrame:
    """df, and in each row what the folds make of the sums of all earlier stretches of its key.

    sums: aggregates of a stretch. A fold gets the stretches' order and the frame of all earlier ones, and returns columns;
    later folds may use the columns of those before; those that begin with __ are not carried.
    """
    ends = df.groupBy(*keys, "_s").agg(*(c.alias(n) for n, c in sums.items()))
    order = Window.partitionBy(*keys).orderBy("_s")
    for fold in folds:
        ends = ends.withColumns(fold(order, order.rowsBetween(Window.unboundedPreceding, -1)))
    carry = [c for c in ends.columns if c not in (*keys, "_s", *sums) and not c.startswith("__")]
    return df.join(ends.select(*keys, "_s", *carry), [*keys, "_s"])


def add_held(df: DataFrame, signals: dict[str, Column], keys=KEYS, seconds: int = WEEK) -> DataFrame:
    """Each signal's last value so far that isn't null, as a column of the given name."""
    df = with_stretch(df, seconds).withColumns({f"_x_{n}": c for n, c in signals.items()})
    w = inside_so_far(keys)
    df = df.withColumns({f"_in_{n}": F.last(f"_x_{n}", True).over(w) for n in signals})
    df = carried(df, {f"__end_{n}": F.max_by(f"_in_{n}", "ts") for n in signals}, lambda _, before: {f"_was_{n}": F.last(f"__end_{n}", True).over(before) for n in signals}, keys=keys)
    out = df.withColumns({n: F.coalesce(f"_in_{n}", f"_was_{n}") for n in signals})
    return out.drop("_s", *(f"{p}_{n}" for p in ("_x", "_in", "_was") for n in signals))


def _equity_sums(net: Column, keys) -> tuple[dict[str, Column], dict[str, Column]]:
    """In-stretch columns of the product so far and its peak, and their sums."""
    w = inside_so_far(keys)
    return {"_p": F.product(1 + net).over(w)}, {"_m": F.max("_p").over(w)}


def _equity_folds() -> tuple[Callable, Callable]:
    def product(_: WindowSpec, before: WindowSpec) -> dict[str, Column]:
        return {"_e": F.coalesce(F.product("__product").over(before), F.lit(1.0))}

    def peak(_: WindowSpec, before: WindowSpec) -> dict[str, Column]:
        return {"_k": F.max(F.col("_e") * F.col("__peak")).over(before)}

    return product, peak


def add_equity(df: DataFrame, net: Column, capital: float = 1.0, keys=KEYS, start: float | None = None) -> DataFrame:
    """equity = capital * product of 1 + net so far, its peak and drawdown, of rows that have their stretch.

    start: a peak that is there before the first row (the capital, say); else the first row's equity is the first peak.
    """
    first, second = _equity_sums(net, keys)
    df = df.withColumns(first).withColumns(second)
    df = carried(df, {"__product": F.max_by("_p", "ts"), "__peak": F.max("_p")}, *_equity_folds(), keys=keys)
    peak = F.greatest("_k", F.col("_e") * F.col("_m"), *([F.lit(start / capital)] if start is not None else []))
    df = df.withColumns({"equity": F.col("_e") * F.col("_p") * capital, "peak": peak * capital})
    return df.withColumn("drawdown", safe_div(F.col("equity"), F.col("peak")) - 1).drop("_p", "_m", "_e", "_k")


def add_drawdown(df: DataFrame, x: str = "close", keys=KEYS, seconds: int = WEEK) -> DataFrame:
    """Peak and drawdown of a column, from in-stretch peaks and the highest of all earlier stretches."""
    df = with_stretch(df, seconds).withColumn("_m", F.max(x).over(inside_so_far(keys)))
    df = carried(df, {"__top": F.max(x)}, lambda _, before: {"_k": F.max("__top").over(before)}, keys=keys)
    df = df.withColumn("peak", F.greatest("_k", "_m"))
    return df.withColumn("drawdown", safe_div(F.col(x), F.col("peak")) - 1).drop("_s", "_m", "_k")


def worst_drawdown(df: DataFrame, net: Column, keys=(), seconds: int = WEEK) -> DataFrame:
    """Product of 1 + net and worst drawdown of each key, from one row a stretch; without keys, of the table as one.

    No row meets the carry: a stretch's lowest product is enough.
    """
    first, second = _equity_sums(net, keys)
    df = with_stretch(df, seconds).withColumns(first).withColumns(second)
    cells = df.groupBy(*keys, "_s").agg(F.max_by("_p", "ts").alias("__product"), F.max("_p").alias("__peak"), F.min("_p").alias("__low"), F.min(safe_div(F.col("_p"), F.col("_m")) - 1).alias("__worst"))
    order = Window.partitionBy(*keys).orderBy("_s")
    for fold in _equity_folds():
        cells = cells.withColumns(fold(order, order.rowsBetween(Window.unboundedPreceding, -1)))
    fall = F.least("__worst", safe_div(F.col("_e") * F.col("__low"), F.col("_k")) - 1)
    return cells.groupBy(*keys).agg((F.product("__product") - 1).alias("total_return"), F.min(fall).alias("max_drawdown"))


@dataclass(frozen=True)
class Merge:
    """A column of a run: its aggregate over rows, and the one that puts parts together."""

    rows: Column
    parts: Callable[[str], Column]


def counted() -> Merge:
    return Merge(F.count("*"), F.sum)


def multiplied(x: Column) -> Merge:
    return Merge(F.product(x), F.product)


def runs(df: DataFrame, state: Column, sums: dict[str, Merge], first: dict[str, Column], keys=KEYS, seconds: int = WEEK, time: str = "ts") -> DataFrame:
    """One row for each run of equal state of a key, in stretches.

    state, first_<n> and last_<n> for the columns of `first`, next_<n> for the row after the run (null where there is
    none), and the sums. Null is a state of its own.
    """
    w = inside(keys, time)
    df = with_stretch(df, seconds, time).withColumns({"_state": state, **{f"_f_{n}": c for n, c in first.items()}})
    new = F.coalesce((~F.col("_state").eqNullSafe(F.lag("_state").over(w))).cast("int"), F.lit(1))
    # a stretch's first row begins a part, whatever came before
    df = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("_r", F.sum("_new").over(inside_so_far(keys, time)))
    parts = df.groupBy(*keys, "_s", "_r").agg(
        F.max("_state").alias("state"), *(F.min_by(f"_f_{n}", time).alias(f"first_{n}") for n in first), *(F.max_by(f"_f_{n}", time).alias(f"last_{n}") for n in first),
        *(m.rows.alias(n) for n, m in sums.items()),
    )
    here = Window.partitionBy(*keys, "_s")
    following = F.lead(F.struct(*(F.col(f"first_{n}").alias(n) for n in first)))
    parts = parts.withColumns({"_of": F.max("_r").over(here), "_next": following.over(here.orderBy("_r"))})
    own = ["state", *(f"{p}_{n}" for n in first for p in ("first", "last")), *sums, "_next"]
    whole = parts.where("_r > 1 AND _r < _of").select(*keys, *own)
    ends = parts.where("_r = 1 OR _r = _of")
    order = Window.partitionBy(*keys).orderBy("_s", "_r")
    # the last part of a stretch is followed by the first of the next
    ends = ends.withColumn("_next", F.when(F.col("_r") == F.col("_of"), following.over(order)).otherwise(F.col("_next")))
    on = (F.col("_r") == 1) & F.col("state").eqNullSafe(F.lag("state").over(order)) & F.lag(F.lit(True)).over(order)
    ends = ends.withColumn("_begins", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("_g", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("_s", "_r")
    met = ends.groupBy(*keys, "_g").agg(
        F.max("state").alias("state"), *(F.min_by(f"first_{n}", at).alias(f"first_{n}") for n in first), *(F.max_by(f"last_{n}", at).alias(f"last_{n}") for n in first),
        *(m.parts(n).alias(n) for n, m in sums.items()), F.max_by("_next", at).alias("_next"),
    )
    return whole.unionByName(met.select(*keys, *own)).select(*keys, *own[:-1], *(F.col("_next")[n].alias(f"next_{n}") for n in first))


def numbered(df: DataFrame, name: str, keys=KEYS, seconds: int = WEEK, time: str = "ts") -> DataFrame:
    """The rows of each key numbered from 1 in order of time, stretch by stretch."""
    df = with_stretch(df, seconds, time).withColumn("_i", F.row_number().over(inside(keys, time)))
    df = carried(df, {"__n": F.count("*")}, lambda _, before: {"_before": F.coalesce(F.sum("__n").over(before), F.lit(0))}, keys=keys)
    return df.withColumn(name, F.col("_before") + F.col("_i")).drop("_s", "_i", "_before")
