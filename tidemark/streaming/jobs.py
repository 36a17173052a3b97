"""Structured Streaming twins of the batch operators: bars, indicator state, triggers, snapshots, landing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.links import spaced
from ..sources.market import BASE_PRICE, utc, write_events


def tick_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Trades from Parquet files landed in a folder; times are cast, since a watermark needs zoned ones."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = utc(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(BASE_PRICE) + F.col("value")).alias("price"), F.col("event_id").alias("tie"))


def bars(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ST1: a bar comes out once, after the watermark has passed its end; rows later than `late` are dropped."""
    order = F.struct("ts", "tie")
    groups = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("_w"))
    out = groups.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


class _Ordered(StatefulProcessor):
    """Feeds each key's prices to `advance` in order of time, a micro-batch at once; the state goes on from batch to batch.

    Rows at or before the last time seen in earlier batches come out as late, without values, and change nothing.
    """

    fields: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(["last timestamp", "n long", *(f"{f} double" for f in self.fields)]))

    def advance(self, s: dict[str, float], n: int, prices: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of outputs for prices n, n + 1, ... (from 0); s is changed to the state after them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "tie"], kind="stable", ignore_index=True)
        kept = self.state.get() if self.state.exists() else None
        last, n = (pd.Timestamp(kept[0]), kept[1]) if kept else (None, 0)
        s = dict(zip(self.fields, kept[2:], strict=True)) if kept else dict.fromkeys(self.fields, 0.0)
        late = frame["ts"] <= last if kept else pd.Series(False, index=frame.index)
        fresh = frame[~late]
        out = pd.DataFrame({"symbol": key[0], "ts": frame["ts"], "price": frame["price"], **dict.fromkeys(self.outputs, np.nan), "late": late})
        if len(fresh):
            for name, values in self.advance(s, n, fresh["price"].to_numpy(float)).items():
                out.loc[~late, name] = values
            self.state.update((fresh["ts"].iloc[-1].to_pydatetime(), n + len(fresh), *(float(s[f]) for f in self.fields)))
        # an indicator that isn't there yet is null
        out[list(self.outputs)] = out[list(self.outputs)].astype(object).where(out[list(self.outputs)].notna(), None)
        yield out

    def close(self) -> None:
        pass


def _recursive(start: float | None, alpha: float, x: np.ndarray) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y' from y = start, or from the first x."""
    whole = x if start is None else np.concatenate([[start], x])
    y = pd.Series(whole).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return y if start is None else y[1:]


class EmaState(_Ordered):
    """ST2."""

    fields, outputs, span = ("ema",), ("ema",), 20

    def advance(self, s, n, prices):
        y = _recursive(s["ema"] if n else None, 2.0 / (self.span + 1), prices)
        s["ema"] = y[-1]
        return {"ema": y}


class RsiState(_Ordered):
    """ST3: Wilder's RSI; the mean of the first `period` changes, then recursive."""

    fields, outputs, period = ("price", "up", "down"), ("rsi",), 14

    def advance(self, s, n, prices):
        p = self.period
        change = np.diff(prices, prepend=s["price"] if n else prices[0])
        s["price"] = prices[-1]
        number = np.arange(n, n + len(prices))  # of changes so far: the first price has none
        means = {}
        for name, moves in (("up", np.maximum(change, 0.0)), ("down", np.maximum(-change, 0.0))):
            seed = (number <= p) & (number > 0)
            total = s[name] + np.cumsum(np.where(seed, moves / p, 0.0))
            rest = moves[number > p]
            means[name] = np.concatenate([total[number <= p], _recursive(total[number <= p][-1] if (number <= p).any() else s[name], 1.0 / p, rest)])
            s[name] = means[name][-1]
        up, down = means["up"], means["down"]
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(down < 1e-12, 100.0, 100 - 100 / (1 + up / down))
        return {"rsi": np.where(number < p, np.nan, rsi)}


class BandState(_Ordered):
    """ST4: rolling mean and population deviation of the last `window` prices in a ring, and Bollinger bands."""

    window, width = 20, 2.0
    fields = tuple(f"p{i}" for i in range(20))
    outputs = ("mean", "std", "upper", "lower")

    def advance(self, s, n, prices):
        w = self.window
        kept = min(n, w - 1)
        before = np.array([s[f"p{(n - kept + i) % w}"] for i in range(kept)])
        whole = np.concatenate([before, prices])
        mean, std = (np.full(len(prices), np.nan) for _ in range(2))
        if len(whole) >= w:
            frames = np.lib.stride_tricks.sliding_window_view(whole, w)
            mean[-len(frames) :], std[-len(frames) :] = frames.mean(axis=1), frames.std(axis=1)
        for i, x in enumerate(prices[-w:], n + len(prices) - min(w, len(prices))):
            s[f"p{i % w}"] = x
        return {"mean": mean, "std": std, "upper": mean + self.width * std, "lower": mean - self.width * std}


class BarState(StatefulProcessor):
    """ST1 with its late rows: a key's bar comes out once its own latest time has passed the bar's end by `late` seconds.

    A row of a bar that has come out in an earlier batch comes out as late, with its price as the close. Where a key gets
    no rows for `idle` seconds of the clock, a timer gives its open bars and ends its state.
    """

    def __init__(self, seconds: int = 3600, late: float = 600.0, idle: float | None = None):
        self.size, self.late, self.idle = seconds * 10**6, int(late * 1e6), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "start long", "first_us long, first_tie long, open double, high double, low double, last_us long, last_tie long, close double, volume double")
        self.seen = handle.getValueState("seen", "us long")

    def _out(self, key, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["ts", "open", "high", "low", "close", "volume", "late"])
        out.insert(0, "symbol", key[0])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out

    def _bar(self, start: int, b) -> tuple:
        return (start, b[2], b[3], b[4], b[7], b[8], False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "tie"], kind="stable", ignore_index=True)
        frame["us"] = frame["ts"].astype("datetime64[us]").astype("int64")
        frame["start"] = frame["us"] // self.size * self.size
        seen = self.seen.get()[0] if self.seen.exists() else None
        late = frame["start"] + self.size <= seen - self.late if seen is not None else pd.Series(False, index=frame.index)
        found = [(r.us, None, None, None, r.price, None, True) for r in frame[late].itertuples(index=False)]
        for start, g in frame[~late].groupby("start"):
            a, z, k = g.iloc[0], g.iloc[-1], (int(start),)
            new = (int(a.us), int(a.tie), float(a.price), float(g["price"].max()), float(g["price"].min()), int(z.us), int(z.tie), float(z.price), float(len(g)))
            if self.bars.containsKey(k):
                old = tuple(self.bars.getValue(k))
                first, last = min(old, new, key=lambda b: b[:2]), max(old, new, key=lambda b: b[5:7])
                new = (*first[:3], max(old[3], new[3]), min(old[4], new[4]), *last[5:8], old[8] + new[8])
            self.bars.updateValue(k, new)
        seen = max(int(frame["us"].max()), seen if seen is not None else int(frame["us"].max()))
        self.seen.update((seen,))
        for k, b in sorted((k[0], tuple(b)) for k, b in self.bars.iterator()):
            if k + self.size <= seen - self.late:
                found.append(self._bar(k, b))
                self.bars.removeKey((k,))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._out(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [self._bar(k, b) for k, b in sorted((k[0], tuple(b)) for k, b in self.bars.iterator())]
        self.bars.clear()
        self.seen.clear()
        yield self._out(key, found)

    def close(self) -> None:
        pass


def bars_with_late(stream: DataFrame, seconds: int = 3600, late: float = 600.0, idle: float | None = None) -> DataFrame:
    """ST1: bars of a stream (symbol, ts, price, tie) as they close, and late rows.

    With `idle` the stream has timers, so it goes on for ever: availableNow doesn't end it.
    """
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, late boolean"
    return stream.groupBy("symbol").transformWithStateInPandas(BarState(seconds, late, idle), schema, "append", "none" if idle is None else "processingTime")


def indicator(stream: DataFrame, processor: _Ordered) -> DataFrame:
    """ST2-ST4 of a stream (symbol, ts, price, tie), with `late` for rows that came after later ones."""
    schema = ", ".join(["symbol string, ts timestamp, price double", *(f"{o} double" for o in processor.outputs), "late boolean"])
    return stream.groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "none")


class TriggerState(StatefulProcessor):
    """ST5: fires when all required tags are there and the key hasn't fired for `cooldown` seconds."""

    def __init__(self, required: tuple[str, ...], cooldown: float):
        self.required, self.cooldown = set(required), cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        at = self.fired.get()[0] if self.fired.exists() else None
        out = []
        for r in frame.itertuples(index=False):
            t = pd.Timestamp(r.ts).timestamp()
            if self.required <= set(r.tags) and (at is None or t - at >= self.cooldown):
                at = t
                out.append((*key, r.ts))
        if at is not None:
            self.fired.update((at,))
        yield pd.DataFrame(out, columns=["workflow", "symbol", "timeframe", "ts"])

    def close(self) -> None:
        pass


def triggers(stream: DataFrame, required: tuple[str, ...], cooldown: float) -> DataFrame:
    """stream: workflow, symbol, timeframe, ts, tags."""
    return stream.groupBy("workflow", "symbol", "timeframe").transformWithStateInPandas(TriggerState(required, cooldown), "workflow string, symbol string, timeframe string, ts timestamp", "append", "none")


def triggers_batch(df: DataFrame, required: tuple[str, ...], cooldown: float) -> DataFrame:
    """The batch twin of triggers(): which tagged events fire follows from their successor links."""
    ready = df.where(F.size(F.array_except(F.array(*map(F.lit, required)), "tags")) == 0)
    return spaced(ready, cooldown, ("workflow", "symbol", "timeframe"))


class SnapshotState(StatefulProcessor):
    """ST6: after each event with integrity, the latest value of every type."""

    def __init__(self, types: tuple[str, ...]):
        self.types = types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "signal_type string", "ts timestamp, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame[frame["historical_integrity"]].sort_values("ts", kind="stable", ignore_index=True)
        known = {k[0]: (pd.Timestamp(v[0]), v[1]) for k, v in self.latest.iterator()}
        out = pd.DataFrame({"symbol": key[0], "ts": frame["ts"]})
        for t in self.types:
            at, value = known.get(t, (None, None))
            news = frame["signal_type"] == t
            if at is not None:
                news &= frame["ts"] >= at  # an older value than the one known is no news
            filled = frame["value"].where(news).ffill()
            filled = filled.fillna(value) if value is not None else filled
            out[t] = filled.astype(object).where(filled.notna(), None)
            if news.any():
                last = frame[news].iloc[-1]
                self.latest.updateValue((t,), (last["ts"].to_pydatetime(), float(last["value"])))
        yield out

    def close(self) -> None:
        pass


def snapshot_stream(stream: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """stream: symbol, ts, signal_type, value, historical_integrity."""
    schema = ", ".join(["symbol string, ts timestamp", *(f"`{t}` double" for t in types)])
    return stream.groupBy("symbol").transformWithStateInPandas(SnapshotState(types), schema, "append", "none")


def land(stream: DataFrame, path: str, checkpoint: str):
    """ST7: each micro-batch into the event store, under its number, so that a batch that is tried again replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        write_events(df, f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def land_in_order(df: DataFrame, folder: str, slot: Column, slots: int) -> None:
    """The rows of slot 0, 1, ... written one after the other, a file each: a file stream takes them in this order.

    slot: the number of the range of arrival times that a row comes in; a file holds one range, so its size is that of the range.
    """
    for k in range(slots):
        df.where(slot == k).coalesce(1).write.mode("append").parquet(folder)


def drained_with_late(stream: DataFrame, path: str, late_path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream that has the column `late` over what is there: its rows, and the late ones, each with the batch they came in.

    A batch writes under its number, so one that is tried again replaces itself.
    """

    def write(df: DataFrame, number: int) -> None:
        df = df.persist()
        df.where("NOT late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.where("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        df.unpersist()

    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return tuple(spark.read.schema(f"{_ddl(stream)}, batch int").parquet(p) for p in (path, late_path))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
