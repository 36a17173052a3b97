"""Bars, ticks and context from tables: scans, validation, resampling, column detection, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEYS, before, need, safe_div
from ..operators.asof import asof

OHLCV = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])
#: Names under which sources keep a bar's time, in the order they are looked for; this library's own tables call it ts.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "open_time", "ts")
#: Ticks: a fixed offset keeps prices well away from zero.
BASE_PRICE = 100.0


def utc(spark: SparkSession) -> SparkSession:
    """Times without a zone are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as trades: symbol, ts, price, tie."""
    events = utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(BASE_PRICE) + F.col("value")).alias("price"), F.col("event_id").alias("tie"))


def to_bars(trades: DataFrame, every: str = "1 hour", keys=KEYS) -> DataFrame:
    """A2: bars of trades (symbol, ts, price, tie): volume counts them, turnover sums their prices."""
    order = F.struct("ts", "tie")
    groups = trades.groupBy(*keys, F.window("ts", every).alias("_w"))
    out = groups.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("price").alias("turnover"))
    return out.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover")


def resample(bars: DataFrame, every: str, keys=KEYS) -> DataFrame:
    """A1: longer bars of bars."""
    need(bars, *keys, "ts", *OHLCV)
    out = bars.groupBy(*keys, F.window("ts", every).alias("_w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select(*keys, F.col("_w.start").alias("ts"), *OHLCV)


def bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    return to_bars(ticks(spark, sf_dir), every)


def read_bars(spark: SparkSession, *paths: str, columns: tuple[str, ...] = ("symbol", "ts", *OHLCV)) -> DataFrame:
    """IO1, IO2: Parquet files as one table; columns that a file lacks are null, others are not read."""
    parts = []
    for p in paths:
        df = spark.read.parquet(p)
        parts.append(df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "symbol" else "double").alias(c) for c in columns)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_liquidations(spark: SparkSession, path: str) -> DataFrame:
    """IO4: CSV or Parquet, by the path's ending."""
    schema = "symbol string, ts timestamp, long_liquidation_notional double, short_liquidation_notional double"
    df = spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.parquet(path)
    need(df, "symbol", "ts", "long_liquidation_notional", "short_liquidation_notional")
    return df


def normal_time(x: Column, kind: str) -> Column:
    """Epoch seconds or (over 1e10) milliseconds, ISO text, or a timestamp."""
    if kind == "string":
        return F.try_to_timestamp(x)
    if kind in ("bigint", "int", "double"):
        return F.when(x > 1e10, F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_seconds(x))
    return x.cast("timestamp")


def normal_symbol(x: Column) -> Column:
    """Upper case, / and _ as -, and a two-part symbol is a swap."""
    s = F.translate(F.upper(F.trim(x)), "/_", "--")
    return F.when(F.size(F.split(s, "-")) == 2, F.concat(s, F.lit("-SWAP"))).otherwise(s)


RULES = ("null_close", "negative_volume", "high_too_low", "low_too_high", "duplicate_ts")


def rule_columns(df: DataFrame, keys=KEYS) -> DataFrame:
    """IO3: one boolean for each rule a row breaks."""
    o, h, l, c = (F.col(x) for x in OHLCV[:4])
    no = F.lit(False)
    return df.withColumns(
        {
            "null_close": c.isNull(),
            "negative_volume": F.coalesce(F.col("volume") < 0, no),
            "high_too_low": F.coalesce(h < F.greatest(o, c, l), no),
            "low_too_high": F.coalesce(l > F.least(o, c, h), no),
            "duplicate_ts": F.count("*").over(Window.partitionBy(*keys, "ts")) > 1,
        }
    )


def validate(df: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """IO3: rows that break no rule, and the others with the rules they break."""
    need(df, *keys, "ts", *OHLCV)
    checked = rule_columns(df.withColumn("ts", normal_time(F.col("ts"), df.schema["ts"].dataType.simpleString())), keys)
    broken = F.array_compact(F.array(*(F.when(F.col(r), r) for r in RULES)))
    checked = checked.withColumn("broken", broken)
    return checked.where(F.size("broken") == 0).select(*df.columns), checked.where(F.size("broken") > 0).drop(*RULES)


def rule_report(df: DataFrame, keys=KEYS) -> DataFrame:
    """IO3, A10-A12: rows, broken rules, nulls and times of each key."""
    checked = rule_columns(df, keys)
    return checked.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(r)).alias(f"n_{r}") for r in RULES), F.count_if(F.col("close").isNull()).alias("n_null_close_values"), (F.count("*") - F.count_distinct("ts")).alias("n_extra_ts"))


def profile(df: DataFrame, start: str, end: str, keys=KEYS) -> DataFrame:
    """IO7, IO12, A22: rows and time range of each key, and whether they cover the window."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("covers", (F.col("first_ts") <= F.to_timestamp(F.lit(start))) & (F.col("last_ts") >= F.to_timestamp(F.lit(end))))


def detect_prices(df: DataFrame, year: int | None = None, order: str | None = None) -> DataFrame:
    """IO10: ts, bid, ask from whichever columns there are; rows without a price go.

    Time: the first of TIME_NAMES there is, as it stands or capitalised; text beside a column Date is that day's time of day
    (yyyyMMdd HH:mm:ss). Without any, rows are numbered by `order` and are a millisecond apart from 2020 on. Prices, whatever
    their case: bid and ask, or close and close + spread, or close for both.
    """
    found = next((n for name in TIME_NAMES for n in (name, name.capitalize()) if n in df.columns), None)
    if found is None:
        need(df, order or "a time or an order")
        number = F.row_number().over(Window.partitionBy(*(["symbol"] if "symbol" in df.columns else [])).orderBy(order)) - 1
        ts = F.timestamp_millis(F.lit(1_577_836_800_000) + number)
    elif df.schema[found].dataType.simpleString() == "string" and "Date" in df.columns:
        ts = F.to_timestamp(F.concat_ws(" ", F.col("Date").cast("string"), F.col(found)), "yyyyMMdd HH:mm:ss")
    else:
        ts = normal_time(F.col(found), df.schema[found].dataType.simpleString())
    names = {c.lower(): c for c in df.columns}
    if "bid" in names and "ask" in names:
        bid, ask = F.col(names["bid"]), F.col(names["ask"])
    elif "close" in names:
        bid = F.col(names["close"])
        ask = bid + F.col(names["spread"]) if "spread" in names else bid
    else:
        raise ValueError("no price columns")
    keep = [F.col(names["symbol"]).alias("symbol")] if "symbol" in names else []
    out = df.select(*keep, ts.alias("ts"), bid.cast("double").alias("bid"), ask.cast("double").alias("ask")).dropna(subset=["ts", "bid", "ask"])
    return out.where(F.year("ts") == year) if year else out


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO5, ST7: event store partitioned by source, symbol and date; only the dates written are replaced."""
    out = events.withColumns({"date": F.to_date("ts"), "metadata": F.to_json("metadata") if dict(events.dtypes)["metadata"] != "string" else F.col("metadata")})
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source", "symbol", "date").parquet(path)


def read_events(spark: SparkSession, path: str, symbol: str, start: str, end: str) -> DataFrame:
    """IO6: events of a symbol with start <= ts <= end; the partitions of symbol and date are pruned."""
    low, high = (F.to_timestamp(F.lit(x)) for x in (start, end))
    return spark.read.parquet(path).where((F.col("symbol") == symbol) & F.col("date").between(F.to_date(low), F.to_date(high)) & F.col("ts").between(low, high)).drop("date")


def run_sql(spark: SparkSession, query: str, tables: dict[str, str], out: str | None = None) -> DataFrame:
    """IO8: any SELECT over Parquet paths named as tables; written to `out` if given."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    df = spark.sql(query)
    if out:
        df.write.mode("overwrite").parquet(out)
    return df


def write_result(df: DataFrame, path: str, keys=KEYS) -> None:
    """IO9: signals, equity, trades, weights or fills, a folder for each key."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_handoff(df: DataFrame, path: str, mapping: dict[str, str]) -> dict[str, str]:
    """IO11: features for a model under the feed's names; returns the written names and types."""
    out = df.select(*(F.col(a).alias(b) for a, b in mapping.items()))
    out.write.mode("overwrite").parquet(path)
    return dict(out.dtypes)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perpetual bars with spot close, funding and open interest that were available when the bar closed.

    Of the events table: purchases and clicks are perpetuals, errors the spot, views the funding, signups the interest.
    """
    all_bars = bars(spark, sf_dir)
    perp = all_bars.where(F.col("symbol").isin("purchase", "click")).withColumn("available_at", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    spot = all_bars.where("symbol = 'error'").select("ts", F.col("close").alias("spot_close"))
    later = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    funding = all_bars.where("symbol = 'view'").select(later.alias("funding_available_at"), ((F.col("close") - 120) / 1e4).alias("funding_rate"))
    interest = all_bars.where("symbol = 'signup'").select(later.alias("oi_available_at"), (F.col("volume") * 1000 + F.col("close")).alias("open_interest"))
    out = perp.join(spot, "ts", "left")
    symbols = F.explode(F.array(F.lit("purchase"), F.lit("click"))).alias("symbol")
    for feed, at in ((funding, "funding_available_at"), (interest, "oi_available_at")):
        feed = feed.select("*", symbols)
        out = asof(out, feed, on="available_at", right_on=at).withColumnRenamed("context_ts", at)
    basis = F.col("close") - F.col("spot_close")
    return out.withColumns({"basis": basis, "basis_bps": F.coalesce(safe_div(basis, F.col("spot_close")), F.lit(0.0)) * 1e4, "basis_available_at": F.when(basis.isNotNull(), F.col("available_at"))})


def price_change(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.withColumn("change", F.col("close") - before(F.col("close"), 1, keys))
