"""Set operators and joins by keys, paths and positions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.plans.bindings import records, table, with_records
from foliant.registry import query


@query("SELECT digest, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha1(text) AS digest FROM documents) GROUP BY 1")
def set_hash_dedup(spark, sf_dir):
    """The first document of each digest: a partial minimum, not a window, so that a hot digest is folded before the shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, min(doc_id) AS first_id, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS place FROM documents GROUP BY 1")
def set_ordered_distinct(spark, sf_dir):
    """Distinct values in the order of their first rows; the few that are left are numbered."""
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first_id")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def set_prune(spark, sf_dir):
    unwanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(unwanted, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS merged, b.v AS replaced FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k")
def set_cache_replace(spark, sf_dir):
    """A keyed store after merging a batch, and after replacing it by the batch: one full outer join."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("old"))
    new = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("merged"), F.col("new").alias("replaced"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name || '.txt' ELSE p_name || '_' || (n - 1) || '.txt' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def set_reserved_names(spark, sf_dir):
    """The first of equal names keeps it, later ones get _1, _2 and so on."""
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, F.concat("p_name", F.lit(".txt"))).otherwise(F.concat("p_name", F.lit("_"), (n - 1).cast("string"), F.lit(".txt"))).alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn_unprocessed(spark, sf_dir):
    """Inputs without an output: an anti-join on the key."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query(with_records("""SELECT job_id, output_path, CAST(row_number() OVER (PARTITION BY job_id ORDER BY first_at, output_path) AS INTEGER) AS place FROM (
    SELECT i.job_id, d.output_path, min(i.item_id) AS first_at FROM item_records i JOIN doc_records d ON i.document_id = d.document_id WHERE d.output_path IS NOT NULL GROUP BY 1, 2)""", "item_records", "doc_records"))
def jn_session_docs(spark, sf_dir):
    """The distinct output paths of a session's documents in the order in which they were named."""
    rows = records(spark, sf_dir, "item_records").select("job_id", "item_id", "document_id").join(records(spark, sf_dir, "doc_records").filter("output_path IS NOT NULL").select("document_id", "output_path"), "document_id")
    first = rows.groupBy("job_id", "output_path").agg(F.min("item_id").alias("first_at"))
    return first.select("job_id", "output_path", F.row_number().over(Window.partitionBy("job_id").orderBy("first_at", "output_path")).alias("place"))


@query(with_records("SELECT i.item_id, d.document_id FROM item_records i JOIN doc_records d ON d.output_path = 'out/' || i.document_id || '.txt'", "item_records", "doc_records"))
def jn_path_doc(spark, sf_dir):
    paths = records(spark, sf_dir, "item_records").select("item_id", F.concat(F.lit("out/"), F.col("document_id").cast("string"), F.lit(".txt")).alias("output_path"))
    return paths.join(records(spark, sf_dir, "doc_records").filter("output_path IS NOT NULL").select("document_id", "output_path"), "output_path").select("item_id", "document_id")


@query("SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS has_truth FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels ORDER BY doc_id, quality, toxic) l ON d.doc_id = l.doc_id")
def jn_gt(spark, sf_dir):
    """Predictions beside their ground truth, the first for each key."""
    first = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("x")).select("doc_id", "x.*", F.lit(True).alias("has_truth"))
    return table(spark, sf_dir, "documents").select("doc_id").join(first, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("has_truth", F.lit(False)).alias("has_truth"))


@query("""WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS pos, l_partkey AS v FROM lineitem WHERE l_returnflag <> 'R'),
    b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) AS pos, l_suppkey AS v FROM lineitem WHERE l_linestatus = 'F')
    SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, coalesce(CAST(a.v AS VARCHAR), '') AS predicted, coalesce(CAST(b.v AS VARCHAR), '') AS truth FROM a FULL JOIN b ON a.k = b.k AND a.pos = b.pos""")
def jn_table_align(spark, sf_dir):
    """Tables of a document by position, predicted beside true; a missing one is empty."""
    items = table(spark, sf_dir, "lineitem")
    place = lambda c: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(c, "l_linenumber")).alias("pos")
    a = items.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), place("l_partkey"), F.col("l_partkey").cast("string").alias("predicted"))
    b = items.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"), place("l_suppkey"), F.col("l_suppkey").cast("string").alias("truth"))
    return a.join(b, ["k", "pos"], "full").select("k", "pos", F.coalesce("predicted", F.lit("")).alias("predicted"), F.coalesce("truth", F.lit("")).alias("truth"))


@query("SELECT l_orderkey, l_linenumber, p_name, coalesce(p_name, 'none') AS note FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def jn_image_result(spark, sf_dir):
    """Elements with the results of their images, where there are any."""
    results = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") * 2).join(results, "k", "left").select("l_orderkey", "l_linenumber", "p_name", F.coalesce("p_name", F.lit("none")).alias("note"))


@query("SELECT d.doc_id, c.doc_id AS cached_id FROM documents d JOIN (SELECT sha256(text) AS sha, lang, source, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2, 3) c ON sha256(d.text) = c.sha AND d.lang = c.lang AND d.source = c.source WHERE d.doc_id % 2 = 1")
def jn_cache(spark, sf_dir):
    """Uploads whose content, model and owner the cache knows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "lang", "source")
    cache = docs.filter("doc_id % 2 = 0").groupBy("sha", "lang", "source").agg(F.min("doc_id").alias("cached_id"))
    return docs.filter("doc_id % 2 = 1").join(cache, ["sha", "lang", "source"]).select("doc_id", "cached_id")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, '') || '|' || coalesce(b.v, '') AS merged FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey > 5) b ON a.k = b.k")
def jn_page_sections(spark, sf_dir):
    """The texts of two sources page by page."""
    n = table(spark, sf_dir, "nation")
    a = n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    b = n.filter("n_nationkey > 5").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return a.join(b, "k", "full").select("k", F.concat(F.coalesce("a", F.lit("")), F.lit("|"), F.coalesce("b", F.lit(""))).alias("merged"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) = lower('cUSTOMER#000000042') OR c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY lower(c_mktsegment))")
def flt_login(spark, sf_dir):
    """The first row of a name, whatever the case."""
    c = table(spark, sf_dir, "customer")
    first = c.groupBy(F.lower("c_mktsegment")).agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey")
    return c.filter(F.lower("c_name") == "customer#000000042").select("c_custkey").unionByName(first).distinct()


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 20")
def prj_session_list(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("conv_id")).limit(20)
