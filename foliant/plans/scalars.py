from pyspark.sql import functions as F

from foliant.operators import text as t
from foliant.plans.bindings import records, table, with_records
from foliant.registry import query


def _pairs(spark, sf_dir):
    """Benchmark items beside the next one."""
    b = table(spark, sf_dir, "benchmark")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")


PAIRS = "SELECT a.item_id, a.text, b.text AS other FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"
WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS n_distinct FROM documents")
def fn_tokenize(spark, sf_dir):
    found = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"))


@query(f"WITH p AS ({PAIRS}), s AS (SELECT item_id, {WORDS.format('text')} AS a, {WORDS.format('other')} AS b FROM p) SELECT item_id, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s")
def set_jaccard_tokens(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(t.jaccard(t.tokens(F.col("text")), t.tokens(F.col("other"))), 6).alias("jaccard"))


@query(f"WITH p AS ({PAIRS}), s AS (SELECT item_id, list_filter({WORDS.format('text')}, lambda x: length(x) >= 2) AS a, {WORDS.format('other')} AS b FROM p) SELECT item_id, round(len(list_intersect(a, b)) * 1.0 / len(a), 6) AS coverage FROM s")
def set_token_coverage(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(t.coverage(t.tokens(F.col("text")), t.tokens(F.col("other"))), 6).alias("coverage"))


@query(f"WITH p AS ({PAIRS}), s AS (SELECT item_id, {WORDS.format('text')} AS a, {WORDS.format('other')} AS b FROM p) SELECT item_id, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1 FROM s")
def set_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(t.set_f1(t.tokens(F.col("text")), t.tokens(F.col("other"))), 6).alias("f1"))


@query(f"""WITH p AS ({PAIRS}), a AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM p), b AS (SELECT item_id, unnest(string_split(other, ' ')) AS w FROM p),
    x AS (SELECT item_id, w, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY 1, 2),
    m AS (SELECT coalesce(x.item_id, y.item_id) AS item_id, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS k FROM x FULL JOIN y ON x.item_id = y.item_id AND x.w = y.w)
    SELECT item_id, round(sum(least(n, k)) * 1.0 / sum(n), 6) AS precision, round(sum(least(n, k)) * 1.0 / sum(k), 6) AS recall, round(2.0 * sum(least(n, k)) / (sum(n) + sum(k)), 6) AS f1 FROM m GROUP BY 1""")
def set_multiset_f1(spark, sf_dir):
    count = lambda c, n: _pairs(spark, sf_dir).select("item_id", F.explode(F.split(c, " ")).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias(n))
    both = count("text", "n").join(count("other", "k"), ["item_id", "w"], "full").fillna(0)
    shared = F.sum(F.least("n", "k"))
    return both.groupBy("item_id").agg(F.round(shared / F.sum("n"), 6).alias("precision"), F.round(shared / F.sum("k"), 6).alias("recall"), F.round(2.0 * shared / (F.sum("n") + F.sum("k")), 6).alias("f1"))


@query("SELECT l_partkey AS id, l_returnflag || p_name AS a, round(levenshtein(p_type, p_brand) * 1.0 / length(p_brand), 6) AS cer FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1")
def fn_cer(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "p_name").alias("a"), F.round(t.cer(F.col("p_type"), F.col("p_brand")), 6).alias("cer"))


@query("SELECT p_partkey, round(levenshtein(p_name, p_type) * 1.0 / length(p_type), 6) AS cer FROM part")
def fn_cer_bench(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.cer_plain(F.col("p_name"), F.col("p_type")).alias("cer"))


@query()
def fn_nid(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(t.nid("text", "other"), 6).alias("nid"))


@query()
def fn_sequence_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(t.sequence_ratio("text", "other"), 6).alias("ratio"))


@query()
def fn_chunk_text(spark, sf_dir):
    """The chunker over every document: number and text of each chunk."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("chunk_id", "chunk"))
    return rows.select("doc_id", "chunk_id", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def fn_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.escape(F.col("html")).alias("escaped"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) AS plain FROM pages""")
def fn_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.plain(F.col("html")).alias("plain"))


@query("""SELECT page_id, list_last(string_split(url, '/')) AS base, CASE WHEN contains(list_last(string_split(url, '/'))[2:], '.') THEN regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') ELSE list_last(string_split(url, '/')) END AS stem,
    CASE WHEN contains(list_last(string_split(url, '/'))[2:], '.') THEN lower(regexp_extract(list_last(string_split(url, '/')), '(\\.[^.]*)$', 1)) ELSE '' END AS suffix FROM pages""")
def fn_path(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", t.base_name(url).alias("base"), t.stem(url).alias("stem"), t.suffix(url).alias("suffix"))


@query("SELECT doc_id, sha256(text) AS sha, sha256(text) || ':model:' || lang || ':' || source AS cache_key, sha256(doc_id || '|' || source)[:16] AS short_id FROM documents")
def hs_sha(spark, sf_dir):
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), F.concat_ws(":", sha, F.lit("model"), "lang", "source").alias("cache_key"), F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source"), 256), 1, 16).alias("short_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def js_codec(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(with_records("SELECT item_id, coalesce(error_message, error_code, 'unknown error') AS message, coalesce(error_code, 'UNKNOWN') AS code FROM item_records", "item_records"))
def js_error(spark, sf_dir):
    return records(spark, sf_dir, "item_records").select("item_id", F.coalesce("error_message", "error_code", F.lit("unknown error")).alias("message"), F.coalesce("error_code", F.lit("UNKNOWN")).alias("code"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'all ') OR contains(lower(text), 'every') OR contains(lower(text), 'list ') OR contains(lower(text), 'entire') OR contains(lower(text), 'exhaustive') OR contains(lower(text), 'complete list')")
def flt_exhaustive(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(t.asks_for_all(F.col("text"))).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE lower(trim(text)) NOT IN ('없음', 'none', 'n/a', 'not found')")
def flt_has_content(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(t.has_content(F.col("text"))).select("conv_id", "turn")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q >= 60 THEN CAST(floor(q / 60) AS INTEGER) || ' min ' || CAST(q % 60 AS INTEGER) || ' s' ELSE CAST(q AS INTEGER) || ' s' END AS said FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 7 AS BIGINT) AS q FROM lineitem)")
def dt_duration_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.duration_text((F.col("l_quantity") * 7).cast("long")).alias("said"))


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) <= 390 AS inside, epoch_us(ts) // 1000 AS ms, strftime(ts, '%-m/%d') AS day_key, ts + INTERVAL 3600 SECOND AS expires FROM events")
def flt_time_window(spark, sf_dir):
    """Within 22:00 to 06:30, over midnight."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").select("event_id", ((minute >= 22 * 60) | (minute <= 6 * 60 + 30)).alias("inside"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.date_format("ts", "M/dd").alias("day_key"), (F.col("ts") + F.expr("INTERVAL 3600 SECOND")).alias("expires"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 1 THEN l_extendedprice ELSE l_extendedprice / l_quantity END, 7) AS speed, round(CAST(l_extendedprice AS BIGINT) * CAST(0.4 AS DOUBLE) * CAST(0.56 AS DOUBLE) / 10, 3) AS cost, round(CASE WHEN greatest(l_tax, l_discount) = 0 THEN 1.0 ELSE least(l_tax, l_discount) / greatest(l_tax, l_discount) END, 6) AS ratio FROM lineitem")
def ma_speed(spark, sf_dir):
    """Seconds a page, cost of the characters, and the ratio of two sizes."""
    top = F.greatest("l_tax", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1.0)), 7).alias("speed"), F.round(F.bround("l_extendedprice").cast("long") * F.lit(0.4) * F.lit(0.56) / 10, 3).alias("cost"), F.round(F.when(top == 0, 1.0).otherwise(F.try_divide(F.least("l_tax", "l_discount"), top)), 6).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, least(100, greatest(0, CAST(trunc(l_extendedprice / 100 - 100) AS INTEGER))) AS percent FROM lineitem")
def ma_clamp_pct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.lit(100), F.greatest(F.lit(0), (F.col("l_extendedprice") / 100 - 100).cast("int"))).alias("percent"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'low' WHEN n_chars < 2000 OR source = 'src0' THEN 'medium' ELSE 'high' END AS confidence FROM documents")
def prj_gt_confidence(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 200, "low").when((n < 2000) | (F.col("source") == "src0"), "medium").otherwise("high").alias("confidence"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '<[^>]+>') AND length(trim(text)) > 10 AND NOT contains(lower(text), 'this image')")
def flt_simple_text(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").filter(~text.rlike("<[^>]+>") & (F.length(F.btrim(text)) > 10) & ~F.contains(F.lower(text), F.lit("this image"))).select("doc_id")


@query("SELECT page_id, len(regexp_extract_all(lower(html), '<tr[ >]')) AS rows, len(regexp_extract_all(lower(html), '<t[dh][ >]')) AS cells, len(regexp_extract_all(lower(html), '<p[ >]')) AS paragraphs, length(html) AS chars FROM pages")
def agg_count_structure(spark, sf_dir):
    n = lambda pattern: F.regexp_count(F.lower("html"), F.lit(pattern)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<tr[ >]").alias("rows"), n("<t[dh][ >]").alias("cells"), n("<p[ >]").alias("paragraphs"), F.length("html").cast("long").alias("chars"))


@query("SELECT doc_id, list_aggregate(list_transform(list_filter(string_split(text, chr(10)), lambda s: len(regexp_extract_all(s, '[A-Za-z0-9]')) >= 2), lambda s: length(s)), 'sum') AS kept_chars FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda s: len(regexp_extract_all(s, '[A-Za-z0-9]')) >= 2)) > 0")
def flt_ole_line(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda s: F.regexp_count(s, F.lit("[A-Za-z0-9]")) >= 2)
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    return rows.select("doc_id", F.aggregate("lines", F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("kept_chars"))
