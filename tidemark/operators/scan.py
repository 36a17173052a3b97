"""Recursive indicators as a two-level prefix scan.

A symbol's history is cut into blocks. Inside a block the recursion
y = a * x + (1 - a) * y' is a weighted running sum; the block's end, as a
function of what came before it, is one row. Those few rows are folded into
each block's carry, which a join brings back. A long history is therefore many
tasks, and the fold's rows are a block's length fewer than the bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, by_time, safe_div
from ..functions.indicators import add_td_setup
from .stretches import numbered


def add_blocks(df: DataFrame, keys=KEYS, length: int = 64, seconds: int = 7 * 86400) -> DataFrame:
    """_n (row number from 1), _block (of `length` rows) and _j (place in the block from 0).

    Rows are counted by stretches of `seconds` first, so that no window needs a whole history.
    """
    stretch = F.floor(F.unix_timestamp("ts") / seconds)
    df = df.withColumn("_stretch", stretch)
    sizes = df.groupBy(*keys, "_stretch").agg(F.count("*").alias("_size"))
    start = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_stretch", start.alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("ts"))
    df = df.withColumn("_inner", inner).join(sizes, [*keys, "_stretch"])
    df = df.withColumn("_n", F.col("_start") + F.col("_inner"))
    return df.withColumns({"_block": F.floor((F.col("_n") - 1) / length), "_j": (F.col("_n") - 1) % length}).drop("_stretch", "_start", "_inner")


@dataclass(frozen=True)
class Recursion:
    """y = alpha * x + (1 - alpha) * y' from y = x on the first row, null for the first `least` - 1 rows; x has no nulls."""

    source: str
    alpha: float
    name: str
    least: int = 1


def add_recursions(df: DataFrame, wanted: list[Recursion], keys=KEYS, length: int = 64) -> DataFrame:
    """A column for each recursion; blocks are cut, and their ends folded, once for all of them.

    With q = 1 - alpha and in-block place j, y_j = q**(j+1) * carry + q**j * sum(w_i * q**-i).
    """
    rates = [1.0 - r.alpha for r in wanted]
    length = max(1, min([length, *(int(600 / max(1e-9, -_log10(q))) for q in rates if q > 0)]))
    df = add_blocks(df, keys, length)
    so_far = Window.partitionBy(*keys, "_block").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    weight = lambda r: F.when(F.col("_n") == 1, F.col(r.source)).otherwise(r.alpha * F.col(r.source))
    df = df.withColumns({f"_inside_{i}": F.pow(F.lit(q), F.col("_j")) * F.sum(weight(r) * F.pow(F.lit(q), -F.col("_j"))).over(so_far) for i, (r, q) in enumerate(zip(wanted, rates, strict=True))})
    tails = [F.max_by(f"_inside_{i}", "_j").alias(f"t{i}") for i in range(len(wanted))]
    ends = df.groupBy(*keys, "_block").agg(*tails, F.count("*").alias("size"))
    list_ = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "size", *(f"t{i}" for i in range(len(wanted)))))).alias("_ends"))

    def step(acc: Column, x: Column) -> Column:
        carry = F.struct(*((acc["carry"][f"c{i}"] * F.pow(F.lit(q), x["size"]) + x[f"t{i}"]).alias(f"c{i}") for i, q in enumerate(rates)))
        return F.struct(carry.alias("carry"), F.array_append(acc["out"], F.struct((x["_block"] + 1).alias("_block"), carry.alias("_carry"))).alias("out"))

    kind = ",".join(f"c{i}:double" for i in range(len(wanted)))
    start = F.struct(F.struct(*(F.lit(0.0).alias(f"c{i}") for i in range(len(wanted)))).alias("carry"), F.array().cast(f"array<struct<_block:bigint,_carry:struct<{kind}>>>").alias("out"))
    carries = list_.select(*keys, F.explode(F.aggregate("_ends", start, step, lambda a: a["out"])).alias("_c")).select(*keys, "_c._block", "_c._carry")
    df = df.join(carries, [*keys, "_block"], "left")
    y = lambda i, q: F.pow(F.lit(q), F.col("_j") + 1) * F.coalesce(F.col("_carry")[f"c{i}"], F.lit(0.0)) + F.col(f"_inside_{i}")
    out = df.withColumns({r.name: F.when(F.col("_n") >= r.least, y(i, q)) for i, (r, q) in enumerate(zip(wanted, rates, strict=True))})
    return out.drop("_n", "_block", "_j", "_carry", *(f"_inside_{i}" for i in range(len(wanted))))


def add_recursive(df: DataFrame, source: str, alpha: float, name: str, least: int, keys=KEYS, length: int = 64, seeded: str | None = None) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y' from y = x on the first row, null for the first `least` - 1 rows.

    source has no nulls. seeded: a column that, where it isn't null, is y itself (the start of the recursion), and rows
    before it count as nothing. With q = 1 - alpha and in-block place j, y_j = q**(j+1) * carry + q**j * sum(w_i * q**-i).
    """
    q = 1.0 - alpha
    length = max(1, min(length, int(600 / max(1e-9, -_log10(q))))) if q > 0 else length
    df = add_blocks(df, keys, length)
    first = F.col("_n") == 1
    weight = F.when(first, F.col(source)).otherwise(alpha * F.col(source))
    if seeded:
        weight = F.when(F.col(seeded).isNotNull(), F.col(seeded)).when(F.max(F.col(seeded).isNotNull()).over(by_time(keys).rowsBetween(Window.unboundedPreceding, 0)), alpha * F.col(source)).otherwise(0.0)
    df = df.withColumn("_w", weight)
    w = Window.partitionBy(*keys, "_block").orderBy("_j")
    inside = F.pow(F.lit(q), F.col("_j")) * F.sum(F.col("_w") * F.pow(F.lit(q), -F.col("_j"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_inside", inside)
    ends = df.groupBy(*keys, "_block").agg(F.max_by("_inside", "_j").alias("tail"), F.count("*").alias("size"))
    list_ = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "tail", "size"))).alias("_ends"))

    def step(acc: Column, x: Column) -> Column:
        carry = acc["carry"] * F.pow(F.lit(q), x["size"]) + x["tail"]
        return F.struct(carry.alias("carry"), F.array_append(acc["out"], F.struct((x["_block"] + 1).alias("_block"), carry.alias("_carry"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<_block:bigint,_carry:double>>").alias("out"))
    carries = list_.select(*keys, F.explode(F.aggregate("_ends", start, step, lambda a: a["out"])).alias("_c")).select(*keys, "_c._block", "_c._carry")
    df = df.join(carries, [*keys, "_block"], "left")
    y = F.pow(F.lit(q), F.col("_j") + 1) * F.coalesce("_carry", F.lit(0.0)) + F.col("_inside")
    ready = F.col("_n") >= least
    if seeded:
        ready = F.max(F.col(seeded).isNotNull()).over(by_time(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(ready, y)).drop("_n", "_block", "_j", "_w", "_inside", "_carry")


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def add_ema(df: DataFrame, span: int, source: str = "close", name: str | None = None, keys=KEYS, length: int = 64) -> DataFrame:
    """Exponential mean of span, from the first value on, null for the first span - 1 rows."""
    return add_recursive(df, source, 2.0 / (span + 1), name or f"ema_{span}", span, keys, length)


def add_trend(df: DataFrame, keys=KEYS, spans: tuple[int, ...] = (10, 20, 50, 200)) -> DataFrame:
    """The means of all spans, the close's distance from each, and the 50-span mean over the 200-span one."""
    df = add_recursions(df, [Recursion("close", 2.0 / (n + 1), f"ema_{n}", n) for n in spans], keys)
    df = df.withColumns({f"ema_dist_{n}": safe_div(F.col("close"), F.col(f"ema_{n}")) - 1 for n in spans})
    return df.withColumn("trend_strength_50_200", safe_div(F.col("ema_50"), F.col("ema_200")) - 1)


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys=KEYS) -> DataFrame:
    """The signal line starts where the slow mean is there; it is the exponential mean of the rows from then on."""
    df = add_recursions(df, [Recursion("close", 2.0 / (fast + 1), "_fast"), Recursion("close", 2.0 / (slow + 1), "_slow")], keys)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = add_recursions(df, [Recursion("macd", 2.0 / (signal + 1), "macd_signal")], keys)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_wilder_rsi(df: DataFrame, n: int = 14, keys=KEYS, name: str = "wilder_rsi") -> DataFrame:
    """The batch twin of the streaming RSI: the first n changes' mean, then y = x / n + y' * (n - 1) / n."""
    change = F.col("close") - F.lag("close").over(by_time(keys))
    df = df.withColumns({"_up": F.greatest(F.coalesce(change, F.lit(0.0)), F.lit(0.0)), "_down": F.greatest(F.coalesce(-change, F.lit(0.0)), F.lit(0.0)), "_i": F.row_number().over(by_time(keys))})
    w = by_time(keys).rowsBetween(-(n - 1), 0)
    for x in ("_up", "_down"):
        df = df.withColumn(f"{x}_seed", F.when(F.col("_i") == n + 1, F.avg(x).over(w)))
        df = add_recursive(df, x, 1.0 / n, f"{x}_avg", 1, keys, seeded=f"{x}_seed")
    gain, loss = F.col("_up_avg"), F.col("_down_avg")
    value = F.when(loss < 1e-12, 100.0).otherwise(100 - 100 / (1 + gain / F.when(loss >= 1e-12, loss)))
    return df.withColumn(name, F.when(gain.isNotNull(), value)).drop("_up", "_down", "_i", "_up_seed", "_down_seed", "_up_avg", "_down_avg")


def td_setup_in_blocks(df: DataFrame, length_: int = 9, lag: int = 4, keys=KEYS, length: int = 4096) -> DataFrame:
    """add_td_setup() block by block: a run that crosses a border is counted from the halo."""
    df = numbered(df, "_bar", keys)
    return with_halo(df, lambda d, k: add_td_setup(d, length_, lag, k, F.col("_bar")), length_ + lag, keys, length).drop("_bar")


def with_halo(df: DataFrame, transform, lookback: int, keys=KEYS, length: int = 4096) -> DataFrame:
    """A transform of finite memory, block by block: each block also sees the last `lookback` rows before it.

    transform(df, keys) must need no row further back than `lookback`. The rows are those of the plain transform.
    """
    df = add_blocks(df, keys, length)
    near = F.col("_j") >= length - lookback
    copies = F.when(near & F.lit(lookback < length), F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own"))))
    if lookback >= length:
        raise ValueError("the blocks must be longer than the lookback")
    copies = F.coalesce(copies, F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own"))))
    spread = df.withColumn("_x", F.explode(copies)).withColumns({"_halo": F.col("_x.b"), "_own": F.col("_x.own")}).drop("_x", "_n", "_block", "_j")
    return transform(spread, (*keys, "_halo")).where("_own").drop("_halo", "_own")
