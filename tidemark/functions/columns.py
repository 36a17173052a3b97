"""Column helpers: safe division, windows by key and time, guarded rolling aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Standard deviations below this count as none.
TINY = 1e-12
KEYS = ("symbol",)
TIME = "ts"


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0, NaN or null: a flat window has no z-score."""
    return F.when((F.abs(b) > 0) & ~F.isnan(b), a / b)


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def by_time(keys=KEYS, *ties: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(TIME, *ties)


def last_rows(n: int, keys=KEYS) -> WindowSpec:
    return by_time(keys).rowsBetween(-(n - 1), 0)


def so_far(keys=KEYS) -> WindowSpec:
    return by_time(keys).rowsBetween(Window.unboundedPreceding, 0)


def rolling(make, x: Column, n: int, keys=KEYS, least: int | None = None) -> Column:
    """make(x) over the last n rows, null until `least` (n) values are there."""
    w = last_rows(n, keys)
    return F.when(F.count(x).over(w) >= (least or n), make(x).over(w))


def before(x: Column, n: int = 1, keys=KEYS) -> Column:
    return F.lag(x, n).over(by_time(keys))


def deviation(x: Column, n: int, keys=KEYS, population: bool = False) -> Column:
    """Rolling standard deviation; rounding noise of a flat window is 0."""
    s = rolling(F.stddev_pop if population else F.stddev_samp, x, n, keys)
    return F.when(s < TINY, 0.0).otherwise(s)


def zscore(x: Column, n: int, keys=KEYS) -> Column:
    return safe_div(x - rolling(F.avg, x, n, keys), deviation(x, n, keys))


def quantile(x: Column, q: float, n: int, keys=KEYS, least: int | None = None) -> Column:
    """Element at round((m - 1) * q), half to even, of the m sorted values of the last n rows."""
    w = last_rows(n, keys)
    values = F.array_sort(F.collect_list(x).over(w))
    m = F.count(x).over(w)
    return F.when(m >= (least or n), F.try_element_at(values, (F.rint((m - 1) * F.lit(q)) + 1).cast("int")))


def percentile_rank(x: Column, n: int, keys=KEYS) -> Column:
    """Share of the last n values that are at most the current one."""
    w = last_rows(n, keys)
    values, m = F.collect_list(x).over(w), F.count(x).over(w)
    return F.when(m >= n, F.size(F.filter(values, lambda v: v <= x)) / m)


def forward_fill(x: Column, keys=KEYS) -> Column:
    """The last value so far that isn't null."""
    return F.last(x, ignorenulls=True).over(so_far(keys))


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def stages(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """One withColumns for each step, so that a window may use another's result."""
    return reduce(lambda d, s: d.withColumns(s), steps, df)


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
