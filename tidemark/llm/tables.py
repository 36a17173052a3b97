"""Reading the tables and the folds that the queries fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def bounded(spark: SparkSession) -> SparkSession:
    """Batches that go to Python hold 16 MB, however long the texts.

    The driver keeps a description of the plan of each of its last 1,000 executions, and writes it anew whenever a stage
    of the plan ends: 16 KB of it, however many joins the plan has.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.maxPlanStringLength", str(16 << 10))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids are in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def hash_unit(doc_id: Column, salt: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for each id."""
    return (F.xxhash64(F.lit(salt), doc_id).bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a new temporary one only where it is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, clean: bool = False, codec: str | None = None) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    clean: collect the driver's garbage afterwards. Spark deletes the shuffle files of finished rounds only when the plans
    that hold them have been collected, and a driver of many rounds would keep both.
    codec: how Parquet compresses, if not as the session has it; `zstd` keeps whole texts smaller than the default.
    """
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if clean:
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_schema(docs: DataFrame, keep: list[str], more: str) -> StructType:
    """The fields named in `keep`, whatever their names and types, then those of the DDL string."""
    added = StructType.fromDDL(more).fields if more else []
    return StructType([StructField(c, docs.schema[c].dataType) for c in keep] + added)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
