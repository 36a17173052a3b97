"""Work in blocks of rows with an overlap, where Spark's frames would list a window for every row.

A block is `length` rows of one key; a task takes it with the rows that it
needs from its neighbours, as one Arrow table, and works on all rows at once:

  order statistics   a wavelet matrix of the block's ranks: for each bit of the
                     rank the number of zeros so far. The k-th smallest value of
                     any window, and how many are at most x, take one step a
                     bit, so the cost of a row grows with the logarithm of the
                     block, not with the window.
  first touch        tables of the highest high and the lowest low of the next
                     1, 2, 4, ... bars; each row goes down from the largest, over
                     what touches nothing, to the first bar that does.

Memory is that of a block and its overlap. Keys and times have no nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import KEYS
from .stretches import numbered


def in_blocks(df: DataFrame, work: Callable[[pa.Table], dict[str, pa.Array]], more: str, behind: int = 0, ahead: int = 0, keys=KEYS, length: int = 4096) -> DataFrame:
    """df with the columns `more` (DDL) that `work` makes of each block's rows in order of time, of which `behind` and `ahead` come from its neighbours."""
    length = max(length, behind, ahead, 1)
    df = numbered(df, "_n", keys).withColumn("_b", F.floor((F.col("_n") - 1) / length))
    place = (F.col("_n") - 1) % length
    copies = F.array_compact(F.array(F.col("_b"), F.when(place >= length - behind, F.col("_b") + 1), F.when(place < ahead, F.col("_b") - 1)))
    df = df.withColumns({"_at": F.explode(copies)})
    plain = [f for f in df.schema.fields if f.name not in ("_n", "_b", "_at")]
    schema = StructType(plain + StructType.fromDDL(more).fields)

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        own = pa.array(table["_b"].to_numpy() == table["_at"].to_numpy())
        made = work(table)
        for name, values in made.items():
            table = table.append_column(name, values)
        return table.filter(own).select(schema.names)

    return df.groupBy(*keys, "_at").applyInArrow(block, schema)


class Ranks:
    """A wavelet matrix of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        self.sorted, ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.sorted) - 1).bit_length()) if len(self.sorted) else 0
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (ranks >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values low..high - 1, for each of the arrays' entries; 0 <= k < high - low."""
        rank = np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            left = k < b - a
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
            k, rank = np.where(left, k, k - (b - a)), rank * 2 + ~left
        return self.sorted[rank]

    def at_most(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values low..high - 1 are at most x."""
        limit = np.searchsorted(self.sorted, x, "right")  # ranks under this
        count = np.where(limit >= 1 << self.bits, high - low, 0)
        limit, rest = np.where(limit >= 1 << self.bits, 0, limit), self.bits
        for zeros in self.zeros:
            rest -= 1
            a, b = zeros[low], zeros[high]
            right = (limit >> rest) & 1 == 1
            count = count + np.where(right, b - a, 0)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        return count


@dataclass(frozen=True)
class Quantile:
    """The element at round((m - 1) * q), half to even, of the m sorted values of the last n rows; null under `least` (n) values."""

    source: str
    q: float
    n: int
    least: int | None = None


@dataclass(frozen=True)
class Rank:
    """The share of the last n values that are at most the current one; null under n values."""

    source: str
    n: int


def add_order_statistics(df: DataFrame, wanted: dict[str, Quantile | Rank], keys=KEYS, length: int = 4096) -> DataFrame:
    """A column for each of `wanted`. Nulls and NaN are no values; a null has no rank."""

    def work(table: pa.Table) -> dict[str, pa.Array]:
        out, matrices = {}, {}
        for name, w in wanted.items():
            x = table[w.source].cast(pa.float64()).to_numpy()
            here = ~np.isnan(x)
            if w.source not in matrices:
                matrices[w.source] = Ranks(x[here])
            # windows count rows; the matrix holds the values only
            before = np.concatenate([[0], np.cumsum(here)])
            row = np.arange(len(x))
            low, high = before[np.maximum(row - w.n + 1, 0)], before[row + 1]
            m = high - low
            if isinstance(w, Quantile):
                some = m >= max(1, w.least or w.n)
                value = np.full(len(x), np.nan)
                value[some] = matrices[w.source].smallest(low[some], high[some], np.rint((m[some] - 1) * w.q).astype(np.int64))
            else:
                some = (m >= w.n) & here
                value = np.full(len(x), np.nan)
                value[some] = matrices[w.source].at_most(low[some], high[some], x[some]) / m[some]
            out[name] = pa.array(value, mask=~some)
        return out

    return in_blocks(df, work, ", ".join(f"`{n}` double" for n in wanted), behind=max(w.n for w in wanted.values()), keys=keys, length=length)


def first_touch(high: np.ndarray, low: np.ndarray, top: np.ndarray, bottom: np.ndarray, horizon: int) -> np.ndarray:
    """For each row the first of the next `horizon` rows whose high reaches top or whose low reaches bottom; one past them where none does."""
    n = len(high)
    above, below = [high], [low]
    while 2 << (len(above) - 1) <= min(horizon, n):
        h, l, w = above[-1], below[-1], 1 << (len(above) - 1)
        pad = lambda x, fill: np.concatenate([x[w:], np.full(min(w, n), fill)])  # noqa: B023, E731
        above.append(np.maximum(h, pad(h, -np.inf)))
        below.append(np.minimum(l, pad(l, np.inf)))
    at = np.arange(n) + 1
    end = np.minimum(at + horizon, n)
    for k in range(len(above) - 1, -1, -1):
        # the largest step may be taken more than once, each smaller one once
        for _ in range(2 if k == len(above) - 1 else 1):
            fits = at + (1 << k) <= end
            i = np.where(fits, at, 0)
            clear = fits & (above[k][i] < top) & (below[k][i] > bottom)
            at = np.where(clear, at + (1 << k), at)
    return at
