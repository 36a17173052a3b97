"""ST7, IO5, IO6: an event store whose batches are seen whole or not at all.

A batch's rows are written to a folder of their own; then one file with an entry
for each of its partitions is added to the manifest, and only what the manifest
names is read. So a batch that dies half-way isn't seen, and one that is tried
again is seen once: of several commits of one batch a reader takes one.
Compaction rewrites live batches to a folder with few files and commits that
under a name of its own, with the names of the batches that it stands for; a
reader sees either those or it. Folders that no reader can see are left for
whoever clears the store.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "batch string, folder string, stands_for array<string>, source string, symbol string, date date, n_rows long"
KEYS = ("source", "symbol", "date")


def _write(events: DataFrame, root: str, batch: str, stands_for: list[str]) -> None:
    spark = events.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    kind = dict(events.dtypes)["metadata"] if "metadata" in events.columns else None
    rows = events.withColumn("date", F.to_date("ts"))
    rows = rows.withColumn("metadata", F.to_json("metadata")) if kind not in (None, "string") else rows
    # rows of a partition go to one task, so that it is one file
    rows.repartition(*KEYS).write.option("partitionOverwriteMode", "static").partitionBy(*KEYS).parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    entries = spark.read.schema(schema).parquet(folder).groupBy(*KEYS).agg(F.count("*").alias("n_rows"))
    names = F.array(*map(F.lit, stands_for)) if stands_for else F.array().cast("array<string>")
    entries = entries.select(F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), names.alias("stands_for"), *KEYS, "n_rows")
    entries.coalesce(1).write.mode("append").parquet(f"{root}/manifest")  # one file, so that it is there whole or not at all


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """All entries there are; none where nothing has been committed."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ENTRY)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all live partitions."""
    entries = _entries(spark, root)
    replaced = entries.select(F.explode("stands_for").alias("batch")).distinct()
    live = entries.join(replaced, "batch", "left_anti")
    return live.withColumn("_first", F.min("folder").over(Window.partitionBy("batch"))).where(F.col("folder") == F.col("_first")).drop("_first")


def commit(events: DataFrame, root: str, batch: str) -> bool:
    """Adds a batch, unless one of that name has been committed: whether it was added."""
    known = _entries(events.sparkSession, root).where((F.col("batch") == batch) | F.array_contains("stands_for", batch))
    if not known.isEmpty():
        return False
    _write(events, root, batch, [])
    return True


def _rows(spark: SparkSession, schema: str, entries: DataFrame) -> DataFrame:
    """The rows of some live partitions. Their folders, one for each, come to the driver."""
    at = entries.select("folder", F.concat_ws("/", "folder", F.concat(F.lit("source="), "source"), F.concat(F.lit("symbol="), "symbol"), F.concat(F.lit("date="), F.col("date").cast("string"))).alias("path"))
    by_folder: dict[str, list[str]] = {}
    for r in at.collect():
        by_folder.setdefault(r["folder"], []).append(r["path"])
    out = spark.createDataFrame([], schema)
    for folder, paths in by_folder.items():
        out = out.unionByName(spark.read.schema(schema).option("basePath", folder).parquet(*paths))
    return out


def read(spark: SparkSession, root: str, schema: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """IO6: events, of a symbol and of start <= ts <= end where these are given; only partitions that the manifest names for them are read.

    schema: DDL of the events, without date.
    """
    entries, rows = manifest(spark, root), F.lit(True)
    if symbol is not None:
        entries = entries.where(F.col("symbol") == symbol)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            t = F.to_timestamp(F.lit(bound))
            entries = entries.where(F.col("date") >= F.to_date(t) if low else F.col("date") <= F.to_date(t))
            rows = rows & (F.col("ts") >= t if low else F.col("ts") <= t)
    return _rows(spark, f"{schema}, date date", entries).where(rows).drop("date")


def compact(spark: SparkSession, root: str, schema: str) -> str | None:
    """Rewrites all live batches as one: its name; None where there is nothing to gain."""
    live = manifest(spark, root)
    names = [r["batch"] for r in live.select("batch").distinct().collect()]
    if len(names) < 2:
        return None
    name = f"compact-{uuid.uuid4().hex}"
    _write(_rows(spark, f"{schema}, date date", live).drop("date"), root, name, sorted(names))
    return name


def land(stream: DataFrame, root: str, checkpoint: str):
    """ST7: each micro-batch committed under its number: one that is tried again is seen once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, number: commit(df, root, f"stream-{number}") and None).start()
