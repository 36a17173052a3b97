"""Streams over many micro-batches: the rows of one batch, and late rows in a table of their own."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs as ST

START = dt.datetime(2024, 1, 1)
SLOTS = 12
SCHEMA = "symbol string, ts timestamp, price double, tie long"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def ticks(n=400, seed=3):
    """(symbol, ts, price, tie, slot): in order of time over SLOTS slots; every 25th row comes one slot late."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randrange(1, 2400)
        out.append([rng.choice("AB"), START + dt.timedelta(seconds=t), 100 + rng.uniform(-5, 5), i, i * SLOTS // n])
        if i % 25 == 7 and out[-1][4] + 1 < SLOTS:
            out[-1][4] += 1
    return [tuple(r) for r in out]


def run(spark, tmp_path, rows, build, slots=SLOTS):
    folder = str(tmp_path / "landed")
    df = spark.createDataFrame(rows, SCHEMA + ", slot int")
    ST.land_in_order(df.drop("slot") if slots == 1 else df, folder, F.lit(0) if slots == 1 else F.col("slot"), slots)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    main, late = ST.drained_with_late(build(stream), str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"))
    return main.collect(), late.collect()


def late_rows(rows, too_late):
    """Rows that too_late(row, latest time of its symbol in earlier slots) holds for, slot by slot."""
    seen, late = {}, []
    for k in range(SLOTS):
        batch = [r for r in rows if r[4] == k]
        late += [r for r in batch if r[0] in seen and too_late(r, seen[r[0]])]
        for r in batch:
            seen[r[0]] = max(seen.get(r[0], r[1]), r[1])
    return late


@pytest.mark.parametrize("make", [ST.EmaState, ST.RsiState, ST.BandState])
def test_indicators_over_batches_equal_one_batch(spark, tmp_path, make):
    rows = ticks()
    late = late_rows(rows, lambda r, seen: r[1] <= seen)
    (tmp_path / "many").mkdir()
    (tmp_path / "one").mkdir()
    many, others = run(spark, tmp_path / "many", rows, lambda s: ST.indicator(s, make()))
    assert len({r.batch for r in many}) >= 10 and late
    assert sorted(r.ts for r in others) == sorted(r[1] for r in late) and all(r.late and r[3] is None for r in others)
    one, none = run(spark, tmp_path / "one", [r for r in rows if r not in late], lambda s: ST.indicator(s, make()), 1)
    assert not none and len(one) == len(many)
    for a, b in zip(sorted(many, key=lambda r: r.ts), sorted(one, key=lambda r: r.ts), strict=True):
        for x, y in zip(a[:-2], b[:-2], strict=True):
            assert x == y or abs(x - y) < 1e-9


def test_ema_and_rsi_equal_row_loops():
    rng = random.Random(1)
    prices = [100 + rng.uniform(-5, 5) for _ in range(90)]
    ema, up, down, want = None, 0.0, 0.0, []
    for i, p in enumerate(prices):
        ema = p if ema is None else p * 2 / 21 + ema * 19 / 21
        change = p - prices[i - 1] if i else 0.0
        if 0 < i <= 14:
            up, down = up + max(change, 0) / 14, down + max(-change, 0) / 14
        elif i:
            up, down = (up * 13 + max(change, 0)) / 14, (down * 13 + max(-change, 0)) / 14
        want.append((ema, None if i < 14 else 100 - 100 / (1 + up / down)))
    import numpy as np

    for cuts in ([90], [1, 3, 10, 14, 15, 16, 40, 90], list(range(1, 91))):
        s, r, n, got = {"ema": 0.0}, dict.fromkeys(ST.RsiState.fields, 0.0), 0, []
        for c in cuts:
            part = np.array(prices[n:c])
            got += zip(ST.EmaState().advance(s, n, part)["ema"], ST.RsiState().advance(r, n, part)["rsi"], strict=True)
            n = c
        for (a, b), (x, y) in zip(got, want, strict=True):
            assert abs(a - x) < 1e-9 and (y is None and np.isnan(b) or y is not None and abs(b - y) < 1e-9)


def bars_of(rows):
    out = {}
    for s, ts, price, tie, _ in sorted(rows, key=lambda r: (r[1], r[3])):
        k = (s, ts.replace(minute=0, second=0))
        b = out.setdefault(k, [price, price, price, price, 0])
        b[1:] = [max(b[1], price), min(b[2], price), price, b[4] + 1]
    return out


def test_bars_over_batches_with_late_rows(spark, tmp_path):
    rows = ticks(seed=9)
    hour, grace = dt.timedelta(hours=1), dt.timedelta(minutes=10)
    late = late_rows(rows, lambda r, seen: r[1].replace(minute=0, second=0) + hour <= seen - grace)
    main, others = run(spark, tmp_path, rows, ST.bars_with_late)
    latest = {s: max(r[1] for r in rows if r[0] == s) for s in "AB"}
    want = {k: v for k, v in bars_of([r for r in rows if r not in late]).items() if k[1] + hour <= latest[k[0]] - grace}
    got = {(r.symbol, r.ts): [r.open, r.high, r.low, r.close, int(r.volume)] for r in main}
    assert len(got) == len(main) and got == want and len({r.batch for r in main}) >= 10
    assert late and sorted((r.symbol, r.ts, r.close) for r in others) == sorted(r[:3] for r in late)


def test_idle_keys_end_with_their_open_bars(spark, tmp_path):
    rows = [("B", START, 1.0, 0, 0), *(("A", START + dt.timedelta(hours=i), float(i), i, i) for i in range(3))]
    ST.land_in_order(spark.createDataFrame(rows, SCHEMA + ", slot int"), str(tmp_path / "landed"), F.col("slot"), 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    out, found = str(tmp_path / "out"), []
    # a stream with timers goes on for ever: it is stopped once the timer has fired, or after a minute
    q = ST.bars_with_late(stream, idle=0.5).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(out) and (found := spark.read.schema("symbol string, ts timestamp, close double").parquet(out).where("symbol = 'B'").collect()):
                break
    finally:
        q.stop()
    assert [(r.ts, r.close) for r in found] == [(START, 1.0)]  # no later row of B
