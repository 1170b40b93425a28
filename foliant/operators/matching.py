"""Predicted tables against true ones: likeness, one-to-one matches, and the evaluations that rest on them.

Tables are rows with rows, cols, header (an array of tokens) and, predicted, page and valid, or, true, pages (an array).
All joins are on the document, so a pair exists only within one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.text import jaccard

# The parts of the likeness, and what an unknown header or page counts.
PARTS, UNKNOWN = {"rows": 0.35, "cols": 0.35, "header": 0.2, "page": 0.1}, 0.5


def size_likeness(a: Column, b: Column) -> Column:
    """1 less the difference over the larger; 1 if either is unknown (0 or null)."""
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(known, 1 - F.abs(a - b) / F.greatest(a, b)).otherwise(1.0)


def tokens(header: Column) -> Column:
    """How many different tokens a header has."""
    return F.coalesce(F.size(F.array_distinct(header)), F.lit(0))


def likeness(p: Column, t: Column, p_tokens: Column, t_tokens: Column) -> Column:
    """How like a predicted table p is to a true table t, whose headers have so many different tokens, to four places."""
    shared = F.size(F.array_intersect(t["header"], F.coalesce(p["header"], F.array().cast("array<string>"))))
    header = F.when(t_tokens <= 0, UNKNOWN).otherwise(shared / (p_tokens + t_tokens - shared))
    page = F.when((F.coalesce(F.size(t["pages"]), F.lit(0)) > 0) & p["page"].isNotNull(), F.array_contains(t["pages"], p["page"]).cast("double")).otherwise(UNKNOWN)
    parts = {"rows": size_likeness(p["rows"], t["rows"]), "cols": size_likeness(p["cols"], t["cols"]), "header": header, "page": page}
    return F.round(sum((PARTS[k] * x for k, x in parts.items()), F.lit(0.0)).cast("decimal(18,10)"), 4).cast("double")


def candidates(predicted: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """doc, t and p (the tables' structs) and score of each true table with each predicted one of its document."""
    side = lambda df, name: df.select(doc, F.struct("*").alias(name), F.greatest(tokens(F.col("header")), F.lit(0)).alias(f"{name}_tokens"))
    rows = side(truth, "t").join(side(predicted, "p"), doc)
    return rows.select(doc, "t", "p", likeness(F.col("p"), F.col("t"), F.col("p_tokens"), F.col("t_tokens")).alias("score"))


def in_order(pairs: DataFrame, doc: str, truth: str = "t.n", predicted: str = "p.n", score: str = "score") -> DataFrame:
    """One match for each true table, in their order: the best predicted one that no earlier table took, the first of equals.

    With a document's pairs sorted by true table, falling score and predicted table, that is the first of each true table
    whose predicted table is free: one fold in the JVM over what a document holds."""
    return matches(pairs, doc, truth, predicted, score).select(doc, F.explode("m").alias("x")).select(doc, F.col("x.t").alias("truth"), F.col("x.p").alias("predicted"), (-F.col("x.s")).alias("score"))


def matches(pairs: DataFrame, doc: str, truth: str = "t.n", predicted: str = "p.n", score: str = "score", *more: Column) -> DataFrame:
    """doc and m, an array of its matches in order: t, s, the score below zero, p, and what more is asked of a pair."""
    best = F.array_sort(F.collect_list(F.struct(F.col(truth).alias("t"), (-F.col(score)).alias("s"), F.col(predicted).alias("p"), *more)))
    kept = F.aggregate(best, F.filter(best, lambda x: F.lit(False)), lambda done, x: F.when(F.exists(done, lambda y: (y["t"] == x["t"]) | (y["p"] == x["p"])), done).otherwise(F.concat(done, F.array(x))))
    return pairs.groupBy(doc).agg(kept.alias("m"))


def grid_evaluation(predicted: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """For each document with a table: predicted tables, valid ones and their share, true tables, matches, matches that are
    valid and of the true size, and their share of the true tables; shares to four places, null of none."""
    p, t = F.col("p"), F.col("t")
    exact = p["valid"] & (p["rows"] == t["rows"]) & (p["cols"] == t["cols"])
    found = matches(candidates(predicted, truth, doc), doc, "t.n", "p.n", "score", exact.alias("exact"))
    m = found.select(doc, F.size("m").cast("long").alias("matched"), F.size(F.filter("m", lambda x: x["exact"])).cast("long").alias("exact"))
    every = predicted.select(doc, F.lit(True).alias("is_p"), "valid").unionByName(truth.select(doc, F.lit(False).alias("is_p"), F.lit(None).cast("boolean").alias("valid")))
    counts = every.groupBy(doc).agg(F.count_if("is_p").alias("predicted"), F.count_if("valid").alias("valid"), F.count_if(~F.col("is_p")).alias("truth"))
    out = counts.join(m, doc, "left").fillna(0, ["predicted", "valid", "truth", "matched", "exact"])
    return out.withColumns({"valid_rate": F.round(F.try_divide("valid", "predicted"), 4), "exact_rate": F.round(F.try_divide("exact", "truth"), 4)})


def multipage_evaluation(predicted: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """For each true table on more than one page: predicted ones of its size or with half its header's tokens, and whether
    exactly one of these is valid and of its size."""
    several = truth.filter(F.size("pages") > 1).select(doc, F.col("n").alias("truth"), F.struct("rows", "cols", "header").alias("t"))
    rows = several.join(predicted.select(doc, F.struct("rows", "cols", "header", "valid").alias("p")), doc, "left")
    p, t = F.col("p"), F.col("t")
    same = F.coalesce((p["rows"] == t["rows"]) & (p["cols"] == t["cols"]), F.lit(False))
    overlap = F.when(F.size(F.array_union(p["header"], t["header"])) > 0, jaccard(p["header"], t["header"])).otherwise(0.0)
    hit = F.coalesce(same | (overlap >= 0.5), F.lit(False)) & p.isNotNull()
    return rows.groupBy(doc, "truth").agg(F.count_if(hit).alias("candidates"), (F.count_if(same & p["valid"]) == 1).alias("merged"))
