"""Scans in stretches against row loops, and trades on literal vectors."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import scan
from tidemark.operators import stretches as ST
from tidemark.plans import ledger as B
from tidemark.plans import metrics as A

START = dt.datetime(2024, 1, 1)


def frame(spark, symbols=("A", "B"), n=120, seed=1):
    """Hourly bars with gaps, prices and signals, of which most are null."""
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        hour, close = rng.randrange(5), 100.0
        for _ in range(n):
            hour += rng.choice((1, 1, 1, 2, 30))
            close *= 1 + rng.uniform(-0.05, 0.05)
            rows.append((s, START + dt.timedelta(hours=hour), close, rng.choice((None, None, None, 1.0, 0.0, -1.0, 0.4))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, signal double")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("symbol", "ts").collect()]


def close_to(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert (a is None) == (b is None) and (a == b or abs(a - b) < 1e-9 if isinstance(a, float) else a == b), (g, w)


@pytest.mark.parametrize("seconds", [3600, 6 * 3600, 5 * 86400, 10**9])
@pytest.mark.parametrize("long_only", [True, False])
def test_ledger_in_stretches_equals_row_loop(spark, seconds, long_only):
    df = frame(spark)
    want = []
    for _, part in itertools.groupby(rows_of(df, "symbol", "ts", "close", "signal"), key=lambda r: r[0]):
        held = target = position = before = 0.0
        equity = peak = last = None
        for symbol, ts, close, signal in part:
            before, position = position, target
            held = held if signal is None else signal
            target = max(0.0 if long_only else -1.0, min(1.0, held))
            gain = 0.0 if last is None else close / last - 1
            net = position * gain - abs(position - before) * 0.01
            equity = (1000.0 if equity is None else equity) * (1 + net)
            peak = equity if peak is None else max(peak, equity)
            last = close
            want.append((symbol, ts, target, position, net, equity, peak, equity / peak - 1))
    names = ("symbol", "ts", "target_position", "position", "net_return", "equity", "peak", "drawdown")
    close_to(rows_of(B.ledger_in_stretches(df, F.lit(0.01), 1000.0, long_only=long_only, seconds=seconds), *names), want)
    close_to(rows_of(B.ledger(df, F.lit(0.01), 1000.0, long_only=long_only), *names[:-2]), [w[:-2] for w in want])


@pytest.mark.parametrize("seconds", [3600, 86400])
def test_worst_drawdown_of_cells(spark, seconds):
    df = B.ledger(frame(spark, seed=3))
    got = {r.symbol: (r.total_return, r.max_drawdown) for r in ST.worst_drawdown(df, F.col("net_return"), ("symbol",), seconds).collect()}
    for symbol, part in itertools.groupby(rows_of(df, "symbol", "net_return"), key=lambda r: r[0]):
        equity, peak, worst = 1.0, None, 0.0
        for _, r in part:
            equity *= 1 + r
            peak = equity if peak is None else max(peak, equity)
            worst = min(worst, equity / peak - 1)
        assert abs(got[symbol][0] - (equity - 1)) < 1e-9 and abs(got[symbol][1] - worst) < 1e-9


@pytest.mark.parametrize("seconds", [3600, 7 * 3600, 10**9])
def test_runs_are_put_together_over_borders(spark, seconds):
    df = frame(spark, seed=5).withColumn("state", F.when(F.col("signal") != 0.4, F.col("signal") > 0))
    want = []
    data = rows_of(df, "symbol", "ts", "state", "close")
    for i, (key, part) in enumerate(itertools.groupby(data, key=lambda r: (r[0], r[2]))):
        part = list(part)
        nxt = data.index(part[-1]) + 1
        nxt = data[nxt][1] if nxt < len(data) and data[nxt][0] == key[0] else None
        want.append((key[0], key[1], part[0][1], part[-1][1], nxt, len(part), sum(p[3] for p in part)))
    out = ST.runs(df, F.col("state"), {"n": ST.counted(), "total": ST.Merge(F.sum("close"), F.sum)}, {"ts": F.col("ts")}, seconds=seconds)
    got = sorted(((r.symbol, r.state, r.first_ts, r.last_ts, r.next_ts, r.n, r.total) for r in out.collect()), key=lambda r: (r[0], r[2]))
    close_to(got, want)


def test_trade_log_enters_and_leaves_at_the_bars_of_the_position(spark):
    rows = [("X", START + dt.timedelta(hours=i), c, p, c / b - 1) for i, (b, c, p) in enumerate(((10, 10, 0), (10, 11, 1), (11, 12, 1), (12, 13, 0), (13, 20, 0.5), (20, 30, -0.5), (30, 15, 0), (15, 16, 1)))]
    led = spark.createDataFrame([(s, t, float(c), float(p), float(r)) for s, t, c, p, r in rows], "symbol string, ts timestamp, close double, position double, asset_return double")
    for seconds in (3600, 10**9):
        log = B.trade_log(led, seconds=seconds).orderBy("trade_id").collect()
        assert [(r.trade_id, r.entry_price, r.exit_price, r.bars_held, r.side) for r in log] == [(1, 11.0, 13.0, 2, 1), (2, 20.0, 15.0, 2, 1)]
        assert abs(log[0].pnl_percent - 2 / 11) < 1e-12 and log[0].entry_time == START + dt.timedelta(hours=1) and log[0].exit_time == START + dt.timedelta(hours=3)
        # a run's return is the asset's over the bars held, whatever the position's size; the open one counts
        got = B.trade_returns(led, seconds=seconds).orderBy("trade_id").collect()
        assert [round(r.trade_return, 12) for r in got] == [round(x, 12) for x in (12 / 10 - 1, 20 / 13 - 1, 16 / 15 - 1)]


def test_losing_streak_and_metrics_of_both_ledgers(spark):
    df = frame(spark, n=300, seed=7)
    a, b = (A.metrics(x).orderBy("symbol").collect() for x in (B.ledger(df), B.ledger_in_stretches(df, seconds=86400)))
    close_to([tuple(r) for r in b], [tuple(r) for r in a])
    days = spark.createDataFrame([("A", dt.date(2024, 1, i + 1), x) for i, x in enumerate((-1.0, -1.0, 0.0, -1.0, -1.0, -1.0, 2.0, -1.0))], "symbol string, date date, daily_return double")
    for seconds in (86400, 3 * 86400, 10**9):
        assert A.losing_streak(days, seconds=seconds).first()["max_consecutive_losing_days"] == 3


def test_td_setup_begins_with_the_fourteenth_bar(spark):
    rows = [("X", START + dt.timedelta(hours=i), float(100 - i)) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    want = [0] * 13 + [1] * 7
    assert [r.td_setup for r in I.add_td_setup(df).orderBy("ts").collect()] == want
    assert [r.td_setup for r in scan.td_setup_in_blocks(df, length=16).orderBy("ts").collect()] == want


def test_stretches_of_no_rows(spark):
    df = frame(spark).limit(0)
    assert B.ledger_in_stretches(df).count() == 0 and B.trade_returns(B.ledger(df)).count() == 0
