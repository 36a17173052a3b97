"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns all columns of documents for
what it keeps; the last adds the pieces. The result of each is written as
Parquet and read again as the next one's documents.

Null or letterless texts go with the first stage; empty tables pass through.
Repeated rows are one document after the second stage, the same in every run;
rows without an id are never duplicates, and of rows with one id but different
texts each text stays. Further columns of documents, whatever their names, are
carried along in a struct; the last stage's own columns come after them and
replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, neardup, pieces, pii
from tidemark.llm.tables import bounded, fold, materialise, read

#: Shingles of five words, links from 80 of 100.
SHINGLE, PERCENT = 5, 80


def _packed(docs: DataFrame, *more: str) -> DataFrame:
    """All columns of docs in the struct `doc`, then those named, so that an operator's columns clash with none."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *more)


def _unpacked(rows: DataFrame, names: list[str], **new) -> DataFrame:
    return rows.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in names))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the predicted one as their lang; `und` goes."""
    bounded(spark)
    model = language.LanguageModel.fit(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), 5) != 0))
    out = language.identify(_packed(docs, "text"), model, keep=["doc"]).where(F.col("lang_pred") != language.UNKNOWN)
    return _unpacked(out, docs.columns, lang=F.col("lang_pred"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    bounded(spark)
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), SHINGLE, PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = materialise(kept, clean=True)
    stay = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    # of rows of one id and text the first in the order of all their columns
    one = _packed(stay, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).groupBy("doc_id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return _unpacked(one, docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    out = decontaminate.without_leaks(_packed(docs, "text"), read(spark, sf_dir, "benchmark"))
    return _unpacked(out, docs.columns)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and revealing terms replaced; n_chars is that of the new text."""
    text = F.col("doc")["text"]
    clean = pii.with_spans(docs).withColumn("spans", F.concat("base", "terms"))
    clean = clean.select("doc", F.when(F.size("spans") > 0, pii.sanitise(text, F.col("spans"))).otherwise(text).alias("clean"))
    return _unpacked(clean, docs.columns, text=F.col("clean"), n_chars=F.char_length("clean").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces: variant, n_pieces, ids_sha256, lossless, ids."""
    bounded(spark)
    out = pieces.encode(_packed(docs, F.col("doc_id").alias("doc_id"), "text"), ["doc"], with_ids=True)
    own = [c for c in out.columns if c != "doc"]
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in own), *own)


STAGES = [("language", identified), ("near_duplicates", unique), ("decontamination", decontaminated), ("pii", sanitised), ("pieces", encoded)]
#: SQL can't express a stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
