from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import retrieval as r
from foliant.plans.bindings import table
from foliant.registry import query

COSINE = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], v) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v, v))) AS score FROM embeddings, q)"""


def _query(spark, sf_dir) -> list[float]:
    """The first vector, one bounded row."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(COSINE + " SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def top_cosine(spark, sf_dir):
    found = r.top_cosine(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 10, "embedding", "vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(COSINE + " SELECT vec_id, round(score, 6) AS score FROM s")
def ma_cosine(spark, sf_dir):
    v = F.array(*[F.lit(float(x)) for x in _query(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(r.cosine(F.col("embedding").cast("array<double>"), v), 6).alias("score"))


@query("SELECT page_id, round(page_id / 7.0, 6) AS score, list_last(string_split(url, '/')) AS source, html[:500] AS preview FROM pages")
def prj_public_chunk(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *r.public_chunk(F.col("page_id") / 7.0, F.col("url"), F.col("html")))


@query("SELECT conv_id, string_agg('[문서 ' || (turn + 1) || ' | 출처=' || role || ' | 청크=' || turn || ' | 점수=' || printf('%.4f', turn / 4.0) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def fn_context(spark, sf_dir):
    block = r.context_block(F.col("turn") + 1, F.col("role"), F.col("turn"), F.col("turn") / 4.0, F.col("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda y: y["b"]), "\n\n").alias("context"))


RANKED = "SELECT label, vec_id // 10 AS item, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 1009, vec_id) AS INTEGER) AS rank FROM embeddings"


@query(f"""WITH r AS (SELECT * FROM ({RANKED}) WHERE rank <= 10), e AS (SELECT DISTINCT label, vec_id // 10 AS item FROM embeddings WHERE vec_id % 9 = 0 AND label <> 3),
    m AS (SELECT e.label, e.item, min(r.rank) AS rank FROM e LEFT JOIN r ON r.label = e.label AND r.item = e.item GROUP BY 1, 2),
    g AS (SELECT label, count(*) AS n, count(rank) AS hits, min(rank) AS first FROM m GROUP BY 1)
    SELECT l.label, CAST(CASE WHEN hits > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit, round(CAST(coalesce(hits * 1.0 / n, 0.0) AS DOUBLE), 6) AS recall, round(CAST(coalesce(1.0 / first, 0.0) AS DOUBLE), 6) AS mrr FROM (SELECT DISTINCT label FROM r) l LEFT JOIN g ON g.label = l.label""")
def jn_retrieval_match(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    item = F.floor(F.col("vec_id") / 10).alias("item")
    order = Window.partitionBy("label").orderBy(F.col("vec_id") * 7919 % 1009, "vec_id")
    ranked = rows.select("label", item, F.row_number().over(order).alias("rank")).filter("rank <= 10")
    expected = rows.filter("vec_id % 9 = 0 AND label <> 3").select("label", item)
    return r.retrieval_metrics(ranked, expected, "label", "item").select("label", "hit", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
