"""Retrieval over embedded chunks, and how good it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def top_cosine(chunks: DataFrame, query: list[float], k: int, vector: str, tie: str) -> DataFrame:
    """The k chunks nearest to the query, ties by `tie`; a scan, an expression and a top-k without a full sort."""
    score = cosine(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]))
    return chunks.select(tie, score.alias("score")).orderBy(F.desc("score"), tie).limit(k)


def public_chunk(score: Column, source: Column, text: Column) -> list[Column]:
    """What is shown of a chunk: score to six places, base name of the source, 500 characters."""
    return [F.round(score, 6).alias("score"), F.element_at(F.split(source, "/"), -1).alias("source"), F.substring(text, 1, 500).alias("preview")]


def context_block(place: Column, source: Column, chunk: Column, score: Column, text: Column) -> Column:
    return F.concat(F.format_string("[문서 %d | 출처=%s | 청크=%d | 점수=%.4f]\n", place, source, chunk, score), text)


def retrieval_metrics(retrieved: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """Hit, recall and reciprocal rank by key; zeros where nothing is expected. Items are unique among those expected of a
    key, so the greedy match is an equi-join: each takes its best rank."""
    best = retrieved.groupBy(key, item).agg(F.min("rank").alias("rank"))
    matched = expected.select(key, item).distinct().join(best, [key, item], "left")
    found = matched.groupBy(key).agg(F.count("*").alias("expected"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    keys = retrieved.select(key).distinct()
    return keys.join(found, key, "left").select(key, F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(F.try_divide("hits", "expected"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("mrr"))
