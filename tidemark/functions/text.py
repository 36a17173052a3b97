"""Relevance ranking of texts by salient terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-case words of three letters and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))


def rank(docs: DataFrame, terms: dict[str, float], text: str = "text") -> DataFrame:
    """doc_id, overlap (terms present), relevance (their weights); the first of equal texts only."""
    own = words(F.col(text))
    known = F.array(*map(F.lit, terms))
    score = sum((F.when(F.array_contains(F.col("_w"), t), F.lit(w)).otherwise(0.0) for t, w in terms.items()), F.lit(0.0))
    first = docs.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("_h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    out = docs.join(first, "doc_id", "left_semi").withColumn("_w", own)
    return out.select("doc_id", F.size(F.array_intersect("_w", known)).alias("overlap"), score.alias("relevance"))
