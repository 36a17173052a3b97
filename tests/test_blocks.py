"""Work in blocks and by links against row loops; labels and the context gate on literal vectors."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as J
from tidemark.operators import links
from tidemark.operators.blocks import Quantile, Rank, add_order_statistics
from tidemark.plans import research as R

START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def walk(n, seed, spread=0.3):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c *= 1 + rng.uniform(-0.01, 0.01)
        out.append((c, c + rng.random() * spread, c - rng.random() * spread, rng.choice((1, 0, -1, None))))
    return out


def bars(spark, rows, symbol="X"):
    """rows: (close, high, low, side)."""
    data = [(symbol, START + i * MINUTE, *(None if x is None else float(x) for x in r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, close double, high double, low double, side double")


def row_loop(rows, profit, stop, horizon):
    out, n = [], len(rows)
    for i, (entry, _, _, side) in enumerate(rows):
        short, end = (side or 1) < 0, min(i + horizon, n - 1)
        result = None
        for j in range(i + 1, end + 1):
            _, high, low, _ = rows[j]
            won = low <= entry * (1 - profit) if short else high >= entry * (1 + profit)
            lost = high >= entry * (1 + stop) if short else low <= entry * (1 - stop)
            if won or lost:
                price = entry * ((1 - profit if short else 1 + profit) if won else (1 + stop if short else 1 - stop))
                result = (1 if won else -1, j, price, "profit_take" if won else "stop_loss")
                break
        if result is None:
            price = rows[end][0]
            move = entry / price - 1 if short else price / entry - 1
            result = ((move > 0) - (move < 0), end, price, "time")
        label, at, price, hit = result
        out.append((label, START + at * MINUTE, price, entry / price - 1 if short else price / entry - 1, at - i, hit))
    return out


def labelled(df, *args, **more):
    out = R.labels(df, *args, side=F.col("side"), **more).orderBy("ts").collect()
    return [(r.label, r.label_time, r.label_price, r.label_return, r.label_bars, r.barrier_hit) for r in out]


def same(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        assert all(a == b or isinstance(a, float) and abs(a - b) < 1e-12 for a, b in zip(g, w, strict=True)), (i, g, w)


def test_labels_on_literal_vectors(spark):
    # long: take profit at bar 1; both touched at once counts as profit; a time exit takes the return's sign; the last bar ends on itself
    got = labelled(bars(spark, [(100, 100, 100, 1), (105, 111, 99, 1), (104, 104, 104, 1), (103, 103, 103, None)]), 0.1, 0.05, 1)
    assert [(g[0], g[4], g[5]) for g in got] == [(1, 1, "profit_take"), (-1, 1, "time"), (-1, 1, "time"), (0, 0, "time")]
    assert abs(got[0][2] - 110) < 1e-9 and abs(got[1][3] - (104 / 105 - 1)) < 1e-12 and got[3][1] == START + 3 * MINUTE
    tie = labelled(bars(spark, [(100, 100, 100, 1), (100, 120, 80, 1)]), 0.1, 0.1, 5)
    assert tie[0][0] == 1 and tie[0][5] == "profit_take"
    # short: the return is entry / exit - 1
    short = labelled(bars(spark, [(100, 100, 100, -1), (95, 96, 89, -1), (120, 121, 119, -1)]), 0.1, 0.2, 5)
    assert short[0][:1] == (1,) and abs(short[0][2] - 90) < 1e-9 and abs(short[0][3] - (100 / 90 - 1)) < 1e-12
    assert short[1][0] == -1 and short[1][5] == "stop_loss" and abs(short[1][3] - (95 / (95 * 1.2) - 1)) < 1e-12
    with pytest.raises(ValueError):
        R.labels(bars(spark, [(1, 1, 1, 1)]), 0.0, 0.1, 5)


@pytest.mark.parametrize("horizon,n,length", [(5, 300, 64), (200, 900, 64), (10_000, 12_500, 4096)])
def test_labels_equal_row_loop(spark, horizon, n, length):
    rows = walk(n, horizon)
    barrier = {5: 0.02, 200: 0.08, 10_000: 0.45}[horizon]
    same(labelled(bars(spark, rows), barrier, barrier * 0.9, horizon, length=length), row_loop(rows, barrier, barrier * 0.9, horizon))


def test_labels_of_missing_prices(spark):
    got = labelled(bars(spark, [(100, 100, 100, 1), (None, None, None, 1), (101, 130, 99, 1)]), 0.1, 0.1, 5)
    assert got[0][0] == 1 and got[1] == (None,) * 6 and got[2][0] == 0
    assert R.labels(bars(spark, []), 0.1, 0.1, 5).count() == 0


def test_gate_passes_what_is_no_entry_and_knows_two_kinds_of_missing(spark):
    signals = bars(spark, [(1, 1, 1, s) for s in (1, 1, 0, None, 1, 1, -1)]).select("symbol", "ts", "close", F.col("side").cast("int").alias("signal"))
    context = spark.createDataFrame([("X", START + MINUTE, 10.0, 0.5), ("X", START + 4 * MINUTE, 10.0, None), ("X", START + 5 * MINUTE, 90.0, 0.5)], "symbol string, ts timestamp, spread_bps double, depth_imbalance double")
    rows = J.gate(signals, context, max_spread=50.0).orderBy("ts").collect()
    assert [r.context_gate_pass for r in rows] == [False, True, True, True, False, False, True]
    assert [r.signal for r in rows] == [None, 1, 0, None, None, None, -1] and [r.raw_signal for r in rows] == [1, 1, 0, None, 1, 1, -1]
    rows = J.gate(signals, context, max_spread=50.0, suppress_missing=False).orderBy("ts").collect()
    assert [r.context_gate_pass for r in rows] == [True, True, True, True, True, False, True]
    # a depth out of its bounds fails, one without a column isn't asked for
    assert [r.signal for r in J.gate(signals, context, 50.0, depth=(0.6, None)).orderBy("ts").collect()][1] is None
    assert [r.signal for r in J.gate(signals, context.drop("depth_imbalance"), 50.0).orderBy("ts").collect()] == [None, 1, 0, None, 1, None, -1]


@pytest.mark.parametrize("gap", [0, 1, 90, 7200])
def test_spaced_events_equal_the_fold(spark, gap):
    rng, rows = random.Random(gap), []
    for k in "ABC":
        t = 0.0
        for _ in range(150):
            t += rng.choice((0, 0.5, 1, 40, 90, 3000))
            rows.append((k, START + dt.timedelta(seconds=t)))
    want = []
    for k in "ABC":
        last = None
        for t in sorted(t for s, t in rows if s == k):
            if last is None or gap == 0 or (t - last).total_seconds() >= gap:
                last = t
                want.append((k, t))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp")
    assert sorted(map(tuple, links.spaced(df, gap, seconds=600).collect())) == want
    assert links.spaced(df.limit(0), gap).count() == 0


def test_spaced_events_are_linked_by_steps_of_stretches(spark, monkeypatch):
    times = sorted({round(i * 0.7 + (i * 37 % 11) * 0.05, 2) for i in range(3000)})
    sizes, stored = [], links.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(links, "stored", counted)
    df = spark.createDataFrame([("A", START + dt.timedelta(seconds=t)) for t in times], "symbol string, ts timestamp")
    got, want = [r.ts for r in links.spaced(df, 20, seconds=300).orderBy("ts").collect()], []
    for t in times:
        if not want or (START + dt.timedelta(seconds=t) - want[-1]).total_seconds() >= 20:
            want.append(START + dt.timedelta(seconds=t))
    # seven stretches: no round goes over all 3,000 events, and few are needed
    assert got == want and max(sizes) <= 300 and len(sizes) <= 5


def test_order_statistics_equal_row_loops(spark):
    rng = random.Random(4)
    values = [None if rng.random() < 0.2 else float(rng.randrange(30)) for _ in range(400)]
    df = spark.createDataFrame([("X", START + i * MINUTE, v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    wanted = {"q": Quantile("x", 0.37, 50, 10), "top": Quantile("x", 1.0, 7, 1), "rank": Rank("x", 20)}
    got = add_order_statistics(df, wanted, length=64).orderBy("ts").collect()
    for i, r in enumerate(got):
        for name, w in wanted.items():
            seen = sorted(v for v in values[max(0, i - w.n + 1) : i + 1] if v is not None)
            if name == "rank":
                want = sum(v <= values[i] for v in seen) / len(seen) if len(seen) >= w.n and values[i] is not None else None
            else:
                want = seen[round((len(seen) - 1) * w.q)] if len(seen) >= w.least else None
            assert r[name] == want or math.isclose(r[name], want), (i, name)
