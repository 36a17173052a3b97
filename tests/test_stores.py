"""Drifted files, committed batches, blocked correlations and fold cells against plain forms."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import metrics as A
from tidemark.plans import research as R
from tidemark.sources import commits, drift

START = dt.datetime(2024, 1, 1)
EVENT = "source string, signal_type string, symbol string, ts timestamp, value double, historical_integrity boolean, metadata string"


def test_types_widen_by_rule():
    assert drift.united_type({"int", "bigint"}) == "bigint" and drift.united_type({"float", "int"}) == "double"
    assert drift.united_type({"date", "timestamp"}) == "timestamp" and drift.united_type({"double", "string"}) == "string"
    assert drift.united_type({"bigint", "string"}, time=True) == "timestamp" and drift.united_type({"array<int>"}) == "array<int>"
    with pytest.raises(ValueError):
        drift.united_type({"array<int>", "int"})


def test_drifted_files_are_one_table(spark, tmp_path):
    a = spark.createDataFrame([("X", START, 1, 2.0)], "symbol string, ts timestamp, volume int, close double")
    b = spark.createDataFrame([("X", 1704070800000, "NYSE", 3.0)], "symbol string, ts long, venue string, close float")
    c = spark.createDataFrame([("Y", "2024-01-01 02:00:00", 7.5)], "symbol string, ts string, volume double")
    for name, df in (("a", a), ("b", b), ("c", c), ("d", a)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    paths = drift.files(spark, str(tmp_path))
    out = drift.scan(spark, paths)
    assert dict(out.dtypes) == {"symbol": "string", "ts": "timestamp", "volume": "double", "close": "double", "venue": "string", "_file": "string"}
    got = sorted((r._file.split("/")[-2], r.symbol, r.ts.hour, r.volume, r.close, r.venue) for r in out.collect())
    assert got == [("a", "X", 0, 1.0, 2.0, None), ("b", "X", 1, None, 3.0, "NYSE"), ("c", "Y", 2, 7.5, None, None), ("d", "X", 0, 1.0, 2.0, None)]
    states = {(r.path.split("/")[-2], r.column): r.state for r in drift.report(spark, paths, ("symbol", "ts", "volume")).collect()}
    assert states["a", "volume"] == "widened" and states["b", "volume"] == "missing" and states["b", "venue"] == "extra" and states["a", "ts"] == "same" and states["c", "ts"] == "widened"
    assert drift.scan(spark, paths, ("symbol", "close")).columns == ["symbol", "close", "_file"]


def events(spark, rows):
    return spark.createDataFrame([(s, "t", k, START + dt.timedelta(hours=h), v, True, None) for s, k, h, v in rows], EVENT)


def test_batches_are_seen_whole_and_once(spark, tmp_path):
    root = str(tmp_path / "store")
    read = lambda *a: sorted((r.symbol, r.ts, r.value) for r in commits.read(spark, root, EVENT, *a).collect())
    assert read() == []
    one, two, three = (events(spark, [("s", k, h + n, float(n)) for k in "XY" for h in (0, 30)]) for n in (1, 2, 3))
    assert commits.commit(one, root, "1") and not commits.commit(one, root, "1")
    seen = read()
    assert len(seen) == 4
    # a batch that dies before its commit leaves files that nobody sees
    two.withColumn("date", F.to_date("ts")).write.partitionBy("source", "symbol", "date").parquet(f"{root}/data/died")
    assert read() == seen
    # one that was committed twice at the same time counts once
    commits._write(two, root, "2", [])
    commits._write(two, root, "2", [])
    assert len(read()) == 8
    assert read("X", "2024-01-02 00:00:00", "2024-01-02 07:00:00") == [("X", START + dt.timedelta(hours=31), 1.0)]
    before = read()
    name = commits.compact(spark, root, EVENT)
    assert read() == before and {r.batch for r in commits.manifest(spark, root).collect()} == {name}
    assert commits.compact(spark, root, EVENT) is None and not commits.commit(two, root, "2")  # known, though compacted
    assert commits.commit(three, root, "3") and len(read()) == 12
    assert commits.compact(spark, root, EVENT) and len(read()) == 12 and not commits.commit(one, root, "1")


def test_stream_commits_its_batches(spark, tmp_path):
    events(spark, [("s", "X", h, 1.0) for h in range(20)]).repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run has nothing to add
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        commits.land(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    assert commits.read(spark, str(tmp_path / "store"), EVENT).count() == 20
    assert commits.manifest(spark, str(tmp_path / "store")).select("batch").distinct().count() == 4


@pytest.mark.parametrize("block", [2, 64])
def test_correlations_of_blocks_equal_pairs(spark, block):
    rng, data = random.Random(8), {}
    for k in range(7):
        for h in range(60):
            if rng.random() < 0.7:
                data[f"S{k}", h] = 100 + rng.gauss(0, 1) + (0.5 * h if k % 2 else 0)
    df = spark.createDataFrame([(s, START + dt.timedelta(hours=h), v) for (s, h), v in data.items()] + [("S0", START + dt.timedelta(hours=99), None)], "symbol string, ts timestamp, asset_return double")
    got = {(r.symbol_a, r.symbol_b): (r.correlation, r.n_common) for r in A.correlations(df, seconds=7 * 3600, block=block).collect()}
    assert len(got) == 21
    for (a, b), (c, n) in got.items():
        x, y = zip(*((data[a, h], data[b, h]) for h in range(60) if (a, h) in data and (b, h) in data), strict=True)
        mx, my = sum(x) / len(x), sum(y) / len(y)
        want = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        assert a < b and n == len(x) and abs(c - want) < 1e-9


@pytest.mark.parametrize("train,test,step", [(40, 20, 20), (30, 12, 18), (7, 5, 3)])
def test_fold_metrics_equal_copied_folds(spark, train, test, step):
    rng, rows = random.Random(train), []
    for s in "AB":
        for h in range(101):
            rows.append((s, START + dt.timedelta(hours=h), rng.choice((-0.05, -0.01, 0.0, 0.02, 0.03)), float(rng.randrange(2)), rng.random() < 0.5))
    led = spark.createDataFrame(rows, "symbol string, ts timestamp, net_return double, turnover double, is_exposed boolean")
    got = {(r.symbol, r.fold, r.role): r for r in R.fold_metrics(led, train, test, step, seconds=9 * 3600).collect()}
    want = 0
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        for k in range((len(own) - train - test) // step + 1):
            for role, part in (("train", own[k * step : k * step + train]), ("test", own[k * step + train : k * step + train + test])):
                want += 1
                r, eq, peak, worst, run, most = got[s, k, role], 1.0, 0.0, 0.0, 0, 0
                for _, _, net, _, _ in part:
                    eq *= 1 + net
                    peak, run = max(peak, eq), run + 1 if net < 0 else 0
                    worst, most = min(worst, eq / peak - 1), max(most, run)
                assert (r.n_rows, r.first_ts, r.last_ts, r.losing_bars) == (len(part), part[0][1], part[-1][1], most)
                assert abs(r.total_return - (eq - 1)) < 1e-12 and abs(r.max_drawdown - worst) < 1e-12 and abs(r.exposure - sum(p[4] for p in part) / len(part)) < 1e-12
    assert len(got) == want
