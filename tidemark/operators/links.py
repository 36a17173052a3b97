"""Events that keep a distance, by successor links.

After an event fires, the next one that may is the first at least `gap` later.
Inside a stretch of time those links lead from any event to the last that fires
there. What fires before a stretch keeps it closed for less than `gap` of it, so
a stretch is entered no later than by the first event from then on, and as a
whole it is a few steps: of the starts up to there, which event fires last. The
step that follows each step is found by a forward as-of join in stretches; which
steps are taken is what those links reach from each key's first one, found by
pointer doubling: a round marks what the marked reach by their links, then each
link takes the place of the two that it leads over. Rounds grow with the
logarithm of the number of stretches and go over steps, not events; a stretch
that is entered then follows its own links. No key's events are put in one array
or window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from ..sources.store import stored
from .stretches import WEEK, carried, with_stretch

_TIME = pa.timestamp("us", tz="UTC")


def with_following(df: DataFrame, after: str, marks: DataFrame, keys=KEYS, seconds: int = WEEK) -> DataFrame:
    """df with `next`: the key's first time `_at` of marks that is not before the time `after`."""
    own = [c for c in df.columns if c not in keys]
    probes = df.select(*keys, F.col(after).alias("_at"), F.lit(0).alias("_mark"), F.lit(None).cast("timestamp").alias("_found"), F.struct(*own).alias("_own"))
    nothing = F.lit(None).cast(probes.schema["_own"].dataType)
    both = with_stretch(probes.unionByName(marks.select(*keys, "_at", F.lit(1).alias("_mark"), F.col("_at").alias("_found"), nothing.alias("_own"))), seconds, "_at")
    # a mark at the very time is late enough: it comes after the probe
    ahead = Window.partitionBy(*keys, "_s").orderBy("_at", "_mark").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_near", F.first("_found", True).over(ahead))
    both = carried(both, {"__first": F.min("_found")}, lambda order, _: {"_far": F.first("__first", True).over(order.rowsBetween(1, Window.unboundedFollowing))}, keys=keys)
    return both.where("_mark = 0").select(*keys, "_own.*", F.coalesce("_near", "_far").alias("next"))


def _times(table: pa.Table, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct times of a stretch, and for each the place of the first at least `gap` later (their number: none)."""
    t = np.unique(table.column("_t").cast(pa.int64()).to_numpy())
    return t, np.searchsorted(t, t + gap)


def _rows(table: pa.Table, keys, **times: np.ndarray) -> pa.Table:
    """Times under the keys and the stretch that all rows of the table share."""
    n = len(next(iter(times.values())))
    same = {k: pa.repeat(table.column(k)[0], n) for k in (*keys, "_s")}
    return pa.table(same | {k: pa.array(x).cast(_TIME) for k, x in times.items()})


def _steps(keys, gap: int, seconds: int):
    """_at and `leaves` of a stretch: with a start after the last step's _at and up to this one's, `leaves` fires last."""

    def run(table: pa.Table) -> pa.Table:
        t, following = _times(table, gap)
        last = np.where(following < len(t), following, np.arange(len(t)))
        while (last[last] != last).any():
            last = last[last]
        # later starts there are none
        n = int(np.searchsorted(t, table.column("_s")[0].as_py() * seconds * 1_000_000 + gap)) + 1
        t, end = t[:n], t[last[:n]]
        ends = np.append(end[1:] != end[:-1], True)
        return _rows(table, keys, _at=t[ends], leaves=end[ends])

    return run


def _fired(keys, gap: int):
    """The times of a stretch that fire, from the first one not before its `_from` (null: the first) on."""

    def run(table: pa.Table) -> pa.Table:
        t, following = _times(table, gap)
        start, out = table.column("_from")[0], []
        i = 0 if not start.is_valid else int(np.searchsorted(t, start.cast(pa.int64()).as_py()))
        following = following.tolist()
        while i < len(t):
            out.append(i)
            i = following[i]
        return _rows(table, keys, _t=t[np.array(out, np.int64)])

    return run


def spaced(events: DataFrame, gap: float, keys=KEYS, time: str = "ts", seconds: int = WEEK) -> DataFrame:
    """ST5: keys and times of the events that fire when none may within `gap` seconds of the last that did. Without a gap all do."""
    if gap <= 0:
        return events.select(*keys, time)
    micros, later = round(gap * 1e6), F.make_dt_interval(secs=F.lit(float(gap)))
    at = events.select(*keys, F.col(time).alias("_t")).where("_t IS NOT NULL")
    at = stored(with_stretch(at, seconds, "_t"), "events")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema if f.name != "_t")
    steps = stored(at.groupBy(*keys, "_s").applyInArrow(_steps(keys, micros, seconds), f"{kinds}, _at timestamp, leaves timestamp"), "steps")
    first = steps.groupBy(*keys).agg(F.min("_at").alias("_at")).withColumn("fires", F.lit(True))
    links = with_following(steps.select(*keys, F.col("_at").alias("_step"), (F.col("leaves") + later).alias("_from")), "_from", steps, keys, seconds)
    links = links.select(*keys, F.col("_step").alias("_at"), "next").join(first, [*keys, "_at"], "left")
    links = stored(links.withColumn("fires", F.coalesce("fires", F.lit(False))), "links")
    while not links.where("fires AND next IS NOT NULL").isEmpty():
        reached = links.where("fires AND next IS NOT NULL").select(*keys, F.col("next").alias("_at"), F.lit(True).alias("_hit"))
        over = links.select(*keys, F.col("_at").alias("next"), F.col("next").alias("_over"))
        links = links.join(over, [*keys, "next"], "left").join(reached, [*keys, "_at"], "left")
        links = stored(links.select(*keys, "_at", F.col("_over").alias("next"), (F.col("fires") | F.coalesce("_hit", F.lit(False))).alias("fires")), "links")
    taken = steps.join(links.where("fires").select(*keys, "_at"), [*keys, "_at"])
    # one step a stretch is taken at most
    entered = taken.select(*keys, "_s", (F.lag("leaves").over(Window.partitionBy(*keys).orderBy("_at")) + later).alias("_from"))
    out = at.join(entered, [*keys, "_s"]).groupBy(*keys, "_s").applyInArrow(_fired(keys, micros), f"{kinds}, _t timestamp")
    return out.select(*keys, F.col("_t").alias(time))
