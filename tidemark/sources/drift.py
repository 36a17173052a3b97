"""IO2: files whose schemas have drifted apart, read as one table.

The schemas come from the files' footers. Their columns are united, and a column
that has several types takes the narrowest one that holds them all. Files of one
schema are read together, so there are as many branches as schemas, not as files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .market import normal_time

#: Each type with those that it can be widened to, itself first.
WIDER = {
    "boolean": ("boolean", "string"), "tinyint": ("tinyint", "smallint", "int", "bigint", "double", "string"), "smallint": ("smallint", "int", "bigint", "double", "string"), "int": ("int", "bigint", "double", "string"),
    "bigint": ("bigint", "double", "string"), "float": ("float", "double", "string"), "double": ("double", "string"), "date": ("date", "timestamp", "string"), "timestamp_ntz": ("timestamp_ntz", "timestamp", "string"),
    "timestamp": ("timestamp", "string"), "string": ("string",),
}


def united_type(kinds: set[str], time: bool = False) -> str:
    """The narrowest type that holds all of `kinds`; a column of times takes numbers and text for times. No common type: an error."""
    if time and len(kinds) > 1:
        return "timestamp"
    first, *rest = sorted(kinds)
    for kind in WIDER.get(first, (first,)):
        if all(kind in WIDER.get(k, (k,)) for k in rest):
            return kind
    raise ValueError(f"no type holds {', '.join(sorted(kinds))}")


def files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files under a folder, listed by Spark; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return sorted(r["path"] for r in found.select("path").collect())


def united(schemas: list[StructType], times: tuple[str, ...] = ("ts",)) -> dict[str, str]:
    """Columns of all schemas, in the order in which they first come, with their types."""
    kinds: dict[str, set[str]] = {}
    for s in schemas:
        for f in s.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    return {n: united_type(k, n in times) for n, k in kinds.items()}


def _as(c: Column, kind: str, want: str, time: bool) -> Column:
    return normal_time(c, kind) if time and kind != want else c.cast(want)


def scan(spark: SparkSession, paths: list[str], columns: tuple[str, ...] | None = None, times: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The rows of all files with the united columns (or those named), null where a file has none, and `_file`, where each comes from."""
    schemas = {p: spark.read.parquet(p).schema for p in paths}
    want = united(list(schemas.values()), times)
    want = {n: want.get(n, "double") for n in columns} if columns else want
    groups: dict[str, list[str]] = {}
    for p, s in schemas.items():
        groups.setdefault(s.json(), []).append(p)
    out = None
    for same in groups.values():
        schema = schemas[same[0]]
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        df = spark.read.schema(schema).parquet(*same).select("*", F.col("_metadata.file_path").alias("_file"))
        part = df.select(*((_as(F.col(f"`{n}`"), kinds[n], k, n in times) if n in kinds else F.lit(None).cast(k)).alias(n) for n, k in want.items()), "_file")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def report(spark: SparkSession, paths: list[str], required: tuple[str, ...] = (), times: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A row for each file and united or required column: path, column, found, united, and whether it is the same, widened, missing or (if some columns are required) extra."""
    schemas = {p: spark.read.parquet(p).schema for p in paths}
    want = united(list(schemas.values()), times)
    rows = []
    for p, s in schemas.items():
        kinds = {f.name: f.dataType.simpleString() for f in s.fields}
        for n in dict.fromkeys((*want, *required)):
            has = kinds.get(n)
            state = "missing" if has is None else "extra" if required and n not in required else "same" if has == want[n] else "widened"
            if has is not None or not required or n in required:
                rows.append((p, n, has, want.get(n), state))
    return spark.createDataFrame(rows, "path string, column string, found string, united string, state string")
