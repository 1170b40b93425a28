"""Quality of extraction: per-file metrics, and their summaries by engine."""

from pyspark.sql import functions as F

from foliant.operators import text as t
from foliant.plans.bindings import table
from foliant.registry import query


# Tokens a character, and dollars for a million tokens read and written.
TOKENS, READ, WRITTEN = 0.4, 0.40, 0.16


def cost(chars):
    """Estimated dollars of a text, to six places."""
    return F.round(chars * F.lit(TOKENS) / 1_000_000 * F.lit(READ + WRITTEN), 6)


def file_results(turns):
    """Metrics of each predicted text (a turn in lower case) against the true one, rounded to four places before any mean."""
    predicted = F.lower("text")
    return turns.select("conv_id", "turn", F.col("role").alias("engine"), F.when(F.col("turn") == 3, F.lit("parse error")).alias("error"), F.round(t.cer(predicted, F.col("text")), 4).alias("cer"), F.when(F.col("turn") != 1, F.round(t.set_f1(t.tokens(F.col("text")), t.tokens(F.col("role"))), 4)).alias("table_match"), (F.length("text") > 400).alias("multipage_ok"), cost(F.length("text")).alias("cost"))


def summary(results):
    """By engine: all files, errors, means over those without error, share of multi-page passes, sum of costs."""
    ok = F.col("error").isNull()
    mean = lambda c: F.try_divide(F.sum(F.when(ok, F.round(F.col(c) * 10_000).cast("long"))), F.count(F.when(ok, F.col(c))) * 10_000).alias(c)  # noqa: E731  whole ten-thousandths, so that sums are exact
    dollars = F.sum(F.when(ok, F.round(F.col("cost") * 1_000_000).cast("long"))) / 1_000_000
    return results.groupBy("engine").agg(F.count("*").alias("total_files"), F.count_if(~ok).alias("errors"), mean("cer"), mean("table_match"), F.round(F.try_divide(F.count_if(ok & F.col("multipage_ok")), F.count_if(ok)), 6).alias("multipage"), dollars.alias("cost"))


ONE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
DOLLARS = "round(length(text) * 0.4::DOUBLE / 1000000 * 0.56::DOUBLE, 6)"
RESULTS = f"""SELECT conv_id, turn, role AS engine, CASE WHEN turn = 3 THEN 'parse error' END AS error, CASE WHEN length({ONE.format('text')}) > 0 THEN round(levenshtein({ONE.format('lower(text)')}, {ONE.format('text')})::DOUBLE / length({ONE.format('text')}), 4) END AS cer,
    CASE WHEN turn <> 1 THEN CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(2.0 * CAST(list_contains(w, role) AS INTEGER) / (len(w) + 1), 4) END END AS table_match, length(text) > 400 AS multipage_ok, {DOLLARS} AS cost FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM conversations)"""


@query(RESULTS)
def agg_file_metrics(spark, sf_dir):
    return file_results(table(spark, sf_dir, "conversations"))


@query(f"SELECT engine, count(*) AS total_files, count(error) AS errors, CAST(sum(CAST(round(cer * 10000) AS BIGINT)) FILTER (error IS NULL) AS DOUBLE) / CAST(count(cer) FILTER (error IS NULL) * 10000 AS DOUBLE) AS cer, CAST(sum(CAST(round(table_match * 10000) AS BIGINT)) FILTER (error IS NULL) AS DOUBLE) / CAST(count(table_match) FILTER (error IS NULL) * 10000 AS DOUBLE) AS table_match, round(count(*) FILTER (error IS NULL AND multipage_ok) * 1.0 / nullif(count(*) FILTER (error IS NULL), 0), 6) AS multipage, CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) FILTER (error IS NULL) AS DOUBLE) / 1000000 AS cost FROM ({RESULTS}) GROUP BY 1")
def agg_eval_summary(spark, sf_dir):
    return summary(file_results(table(spark, sf_dir, "conversations")))


@query(f"SELECT conv_id, turn, {DOLLARS} AS dollars FROM conversations")
def ma_cost(spark, sf_dir):
    """Dollars that a text is estimated at."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cost(F.length("text")).alias("dollars"))


COUNTS = {"chars": ("length(text)", lambda: F.length("text")), "lines": ("len(string_split(text, chr(10)))", lambda: F.size(F.split("text", "\n"))), "words": ("len(regexp_extract_all(text, '[^ \\t\\n]+'))", lambda: F.regexp_count("text", F.lit("[^ \\t\\n]+"))), "sentences": ("len(regexp_extract_all(text, '[.!?]'))", lambda: F.regexp_count("text", F.lit("[.!?]"))), "digits": ("len(regexp_extract_all(text, '[0-9]'))", lambda: F.regexp_count("text", F.lit("[0-9]")))}


@query("SELECT source AS model, lang AS mode, " + ", ".join(f"round(avg({c}), 4) AS mean_{k}, round(stddev_samp({c}), 4) AS stdev_{k}" for k, (c, _) in COUNTS.items()) + " FROM documents GROUP BY 1, 2")
def agg_structure_stats(spark, sf_dir):
    """Mean and sample deviation of five counts by model and mode."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", *[c().alias(k) for k, (_, c) in COUNTS.items()])
    return rows.groupBy(F.col("source").alias("model"), F.col("lang").alias("mode")).agg(*[f(F.round(g(k), 4), f"{n}_{k}") for k in COUNTS for f, g, n in ((lambda x, name: x.alias(name), F.avg, "mean"), (lambda x, name: x.alias(name), F.stddev_samp, "stdev"))])


@query("SELECT o_orderkey, count(l_orderkey) AS n_tables, count(l_orderkey) = 1 AS passed, coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) * 1.0 / nullif(count(l_orderkey), 0), 0.0) AS valid_rate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def tb_multipage(spark, sf_dir):
    """A multi-page file passes with exactly one predicted table; the share of valid tables beside it."""
    valid = F.when(F.col("l_linenumber") % 2 == 0, 1).when(F.col("l_linenumber").isNotNull(), 0)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_tables"), (F.count("l_orderkey") == 1).alias("passed"), F.coalesce(F.avg(valid), F.lit(0.0)).alias("valid_rate"))
