"""Literal vectors, causality, block mode against simple mode, and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions.columns import rolling
from tidemark.operators import asof as J
from tidemark.operators import scan
from tidemark.plans import features as FT
from tidemark.plans import ledger as B
from tidemark.plans import metrics as A
from tidemark.plans import research as R
from tidemark.plans import signals as SG
from tidemark.sources import events as EV
from tidemark.sources import market as M

START = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="X", minutes=1, **more):
    rows = [(symbol, START + dt.timedelta(minutes=i * minutes), float(c), c + 0.5, c - 0.5, float(c), 1.0 + i) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    for k, values in more.items():
        extra = spark.createDataFrame([(r[1], v) for r, v in zip(rows, values, strict=True)], f"ts timestamp, {k} {'int' if k == 'signal' else 'double'}")
        df = df.join(extra, "ts")
    return df


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-9), (got, want)


def test_resample(spark):
    df = bars(spark, [100.5, 101.5, 102.5, 103.5]).withColumns({"open": F.col("close") - 0.5, "volume": F.col("volume")})
    out = M.resample(df, "2 minutes")
    near(column(out, "open"), [100, 102])
    near(column(out, "close"), [101.5, 103.5])
    near(column(out, "volume"), [3, 7])


def test_moving_averages(spark):
    df = bars(spark, [1, 2, 3, 4])
    near(column(df.withColumn("x", rolling(F.avg, F.col("close"), 3)), "x"), [None, None, 2, 3])
    near(column(scan.add_ema(df, 3), "ema_3"), [None, None, 2.25, 3.125])


def test_rsi_and_atr(spark):
    assert abs(column(I.add_rsi(bars(spark, [1, 2, 3, 2]), 3, flat=100.0), "rsi_3")[-1] - 200 / 3) < 1e-6
    near(column(I.add_true_range(bars(spark, [1, 2, 3, 4]), 2), "atr_2"), [None, 1.25, 1.5, 1.5])


def test_flat_prices_have_no_zscore(spark):
    out = I.add_momentum(bars(spark, [5.0] * 30))
    assert set(column(out, "price_extension")) == {None}


@pytest.mark.parametrize("length", [4, 64])
@pytest.mark.parametrize("span", [2, 20, 200])
def test_scan_blocks_agree(spark, length, span):
    closes = [100 + ((i * 37) % 11) - 5 + 0.1 * i for i in range(300)]
    got = column(scan.add_ema(bars(spark, closes, minutes=600), span, length=length), f"ema_{span}")
    a, y, want = 2 / (span + 1), closes[0], []
    for i, c in enumerate(closes):
        y = c if i == 0 else a * c + (1 - a) * y
        want.append(y if i >= span - 1 else None)
    near(got, want)


def test_halo_agrees(spark):
    df = bars(spark, [100 + (i * 7) % 13 for i in range(200)])
    add = lambda d, keys: d.withColumn("m", rolling(F.avg, F.col("close"), 10, keys))
    near(column(scan.with_halo(df, add, 10, length=32), "m"), column(add(df, ("symbol",)), "m"))


def test_asof_simple_and_blocks(spark):
    left = bars(spark, range(10), minutes=60).select("symbol", "ts", "close")
    right = spark.createDataFrame([("X", START + dt.timedelta(minutes=m), float(v)) for m, v in ((120, 1), (120, 2), (400, 3))], "symbol string, ts timestamp, v double")
    for hours in (None, 2):
        out = J.asof(left, right, ties=("v",), hours=hours)
        near(column(out, "v"), [None, None, 2, 2, 2, 2, 2, 3, 3, 3])
        assert J.no_leak(out).first()["n_future"] == 0


def test_gate(spark):
    s = bars(spark, [1, 2, 3, 4], signal=[None, 1, 0, 1]).select("symbol", "ts", "close", "signal")
    c = spark.createDataFrame([("X", START, 10.0), ("X", START + dt.timedelta(minutes=3), 50.0)], "symbol string, ts timestamp, spread_bps double")
    assert column(J.gate(s, c, max_spread=20.0), "signal") == [None, 1, 0, None]
    assert column(J.gate(s, c.where("false"), max_spread=20.0), "signal") == [None, None, 0, None]


def test_position_lags_and_same_bar_jump_earns_nothing(spark):
    led = B.ledger(bars(spark, [100, 200, 200, 200], signal=[0, 1, 1, 0]))
    assert column(led, "position") == [0, 0, 1, 1]
    near(column(led, "equity"), [1, 1, 1, 1])
    assert R.lag_violations(led).first()["lag_violations"] == 0


def test_ledger_costs_and_identity(spark):
    led = B.ledger(bars(spark, [100, 110, 121, 100, 90], signal=[1, None, 0, 1, None]), F.lit(0.01))
    rows = led.orderBy("ts").collect()
    eq = 1.0
    for r in rows:
        assert abs(r["net_return"] - (r["position"] * r["asset_return"] - r["turnover"] * 0.01)) < 1e-12
        eq *= 1 + r["net_return"]
        assert abs(eq - r["equity"]) < 1e-12
    shorts = B.ledger(bars(spark, [100, 110, 121], signal=[-1, -1, -1]))
    assert set(column(shorts, "position")) == {0}
    assert column(B.ledger(bars(spark, [100, 110, 121], signal=[-1, -1, -1]), long_only=False), "position") == [0, -1, -1]


def test_trades(spark):
    led = B.ledger(bars(spark, [100, 100, 110, 121, 121, 100, 110], signal=[1, 1, 1, 0, 1, 1, 1]))
    t = B.trade_returns(led).orderBy("trade_id").collect()
    near([r["trade_return"] for r in t], [0.21, -1 / 11 * 1.0 + 0 if False else (100 / 121) * (110 / 100) - 1])
    closed = B.trade_log(led).collect()
    assert len(closed) == 1 and abs(closed[0]["pnl_percent"] - 0.21) < 1e-9


def test_labels(spark):
    df = bars(spark, [100, 101, 103, 99, 98, 102])
    out = R.labels(df, 0.02, 0.02, 3).orderBy("ts").collect()
    assert out[0]["barrier_hit"] == "profit_take" and out[0]["label_bars"] == 2
    assert out[2]["barrier_hit"] == "stop_loss" and out[2]["label"] == -1
    one = R.labels(bars(spark, [100])).collect()
    assert one[0]["label"] == 0 and one[0]["barrier_hit"] == "time" and one[0]["label_bars"] == 0


def test_causality(spark):
    closes = [100 + ((i * 37) % 11) - 5 for i in range(300)]
    def frame(xs):
        df = bars(spark, xs).withColumns({"available_at": F.col("ts"), "turnover": F.col("close"), "funding_rate": F.col("close") / 1e4, "open_interest": F.col("volume") * 100, "basis": F.col("close") - 100})
        return FT.feature_dataset(df)
    plain, moved = frame(closes), frame(closes[:220] + [c * 10 for c in closes[220:]])
    names = FT.feature_columns(plain, ["symbol", "ts", "open", "high", "low", "close", "volume", "available_at", "turnover", "funding_rate", "open_interest", "basis"])
    a, b = (df.orderBy("ts").limit(220).select(*names).collect() for df in (plain, moved))
    for x, y in zip(a, b, strict=True):
        for n in names:
            same = x[n] == y[n] or (isinstance(x[n], float) and isinstance(y[n], float) and abs(x[n] - y[n]) < 1e-9)
            assert same, n
    with pytest.raises(ValueError):
        FT.no_future(plain.withColumn("future_ret", F.lit(1)))


def test_validation_splits_bad_rows(spark):
    good = bars(spark, [1, 2, 3])
    bad = good.withColumns({"close": F.when(F.col("volume") == 1, None).otherwise(F.col("close")), "high": F.when(F.col("volume") == 2, 0.0).otherwise(F.col("high"))})
    ok, broken = M.validate(bad)
    assert ok.count() == 1 and broken.count() == 2
    assert M.validate(good.unionByName(good))[1].count() == 6
    assert M.validate(good.where("false"))[0].count() == 0


def test_event_store_and_stream_late_rows(spark, tmp_path):
    e = bars(spark, [1, 2]).select(F.lit("a").alias("source"), F.lit("funding_rate").alias("signal_type"), "symbol", "ts", F.col("close").alias("value"), F.lit(True).alias("historical_integrity"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    M.write_events(e, str(tmp_path / "s"))
    assert M.read_events(spark, str(tmp_path / "s"), "X", "2024-01-01 00:00:00", "2024-01-01 00:00:30").count() == 1
    assert M.read_events(spark, str(tmp_path / "s"), "Y", "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 0


def test_registries_and_params():
    with pytest.raises(ValueError):
        SG.RsiParams(14, 50, 60, 55)
    with pytest.raises(ValueError):
        SG.STRATEGIES.signals("unknown", None)
    assert SG.STRATEGIES.normal(" BB-Breakout ") == "bb_breakout"


def test_metrics_of_nothing(spark):
    led = B.ledger(bars(spark, [1, 2, 3], signal=[0, 0, 0]))
    m = A.metrics(led).first()
    assert m["cumulative_return"] == 0 and m["smart_sharpe"] == 0 and m["max_consecutive_losing_days"] == 0
    assert A.metrics(led.where("false")).count() == 0


def test_context_filter_and_book(spark):
    book = spark.createDataFrame([('{"bids": [["10", "1"], ["9", "2"]], "asks": []}',)], "payload string")
    r = book.select(EV.book_depth(F.col("payload"), 1).alias("b")).first()["b"]
    assert r["best_bid"] == 10 and r["best_ask"] is None and r["bid_size"] == 1
