"""Texts cleaned by the rules of converters and benchmarks, over conversations and documents with such marks put in."""

from pyspark.sql import functions as F

from foliant.operators import cleaning as c
from foliant.plans.bindings import table
from foliant.registry import query

PHRASE = "단순 텍스트 문서입니다. 원문을 그대로 출력하겠습니다: "


def _said(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(f"SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN text ELSE replace('{PHRASE}' || text, '{PHRASE}', '') END, '\\s+', ' ', 'g')) AS plain FROM conversations")
def fn_strip_meta(spark, sf_dir):
    """Every second turn begins with a phrase about the text, which goes."""
    text = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit(PHRASE), "text"))
    return _said(spark, sf_dir).select("conv_id", "turn", c.strip_meta(text).alias("plain"))


@query("SELECT conv_id, turn, regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g') AS key FROM conversations")
def fn_norm_dup(spark, sf_dir):
    """Keys by which texts that repeat each other are told; marks, tags and references around the text go."""
    marked = F.concat(F.lit("[[TABLE]]<b>"), "text", F.lit("</b>&lt;br&gt;[[/table_markdown]]"))
    return _said(spark, sf_dir).select("conv_id", "turn", c.duplicate_key(marked).alias("key"))


@query("SELECT conv_id, turn, regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g') || 'p12참조' AS plain FROM conversations")
def fn_norm_plain(spark, sf_dir):
    """Letters, digits and Hangul alone; a lone bullet goes, a page reference is put in order."""
    return _said(spark, sf_dir).select("conv_id", "turn", c.plain_key(F.concat(F.lit("<p class='x'>o "), "text", F.lit("<br/>&nbsp;</p> 참조 p 12"))).alias("plain"))


ANSWER = "### 최종 확인\n다 맞습니다."


@query()
def fn_clean_vlm(spark, sf_dir):
    """Answers with sections about the image, which go, around the turn's text."""
    kind = F.lit("## 이미지 유형\n사진\n\n## 내용\n")
    return _said(spark, sf_dir).select("conv_id", "turn", c.clean_answer(F.concat(kind, "text", F.lit(f"\n\n## 부가 정보\n- 없음\n{ANSWER}"))).alias("plain"))


TIDY = "trim(regexp_replace(regexp_replace(regexp_replace({}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(f"SELECT conv_id, turn, {TIDY.format('text')} AS plain FROM conversations")
def fn_norm_local(spark, sf_dir):
    """The texts of tagged documents; their heads, marks and page headings go."""
    tagged = F.concat(F.lit("원본 파일: a.pdf\n페이지 수: 1\n" + "-" * 60 + "\n\n## Page 1\n\n[[TABLE]]\n"), "text", F.lit("\n[[/TABLE]]\n"))
    return _said(spark, sf_dir).select("conv_id", "turn", c.plain_output(tagged).alias("plain"))


MARKDOWN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '`{{1,3}}', '', 'g'), '(?m)^\\s{{0,3}}#{{1,6}}\\s*', '', 'g'), '(?m)^\\s*[-*+]\\s+', '', 'g'), '(?m)^\\s*\\d+\\.\\s+', '', 'g'), '\\[(.*?)\\]\\((.*?)\\)', '\\1', 'g')"


@query(f"SELECT conv_id, turn, replace({MARKDOWN.format('text')}, '|', ' ') AS plain FROM conversations")
def fn_strip_md(spark, sf_dir):
    """Text without the marks of Markdown."""
    return _said(spark, sf_dir).select("conv_id", "turn", c.strip_markdown(F.col("text")).alias("plain"))


@query(f"SELECT conv_id, turn, {TIDY.format('replace(' + MARKDOWN.format('text') + ', chr(124), chr(32))')} AS plain FROM conversations")
def fn_norm_ref(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", c.plain_reference(F.col("text")).alias("plain"))


def _tagged(spark, sf_dir):
    """Turns as tagged documents of one page, with a table of two cells and its Markdown."""
    table_html = F.concat(F.lit("<table><tr><td>"), F.col("conv_id").cast("string"), F.lit("<br/>x&amp;y</td><th> "), "role", F.lit("</th></tr></table>"))
    text = F.concat(F.lit("원본 파일: a\n\n## Page 1\n"), "text", F.lit("\n[[TABLE]]\n"), table_html, F.lit("\n[[/TABLE]]\n[[TABLE_MARKDOWN]]| a |[[/TABLE_MARKDOWN]]"))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", "text", text.alias("tagged"))


@query("SELECT conv_id, turn, CAST(1 AS INTEGER) AS tables, md5('<table><tr><td>' || conv_id || '<br/>x&amp;y</td><th> ' || role || '</th></tr></table>') AS first FROM conversations")
def fn_pipeline_tables(spark, sf_dir):
    tables = c.marked_tables(F.col("tagged"))
    return _tagged(spark, sf_dir).select("conv_id", "turn", F.size(tables).alias("tables"), F.md5(F.get(tables, F.lit(0))).alias("first"))


SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
EVALUATED = "md5(trim(regexp_replace(regexp_replace(text, '\\[\\[.*?\\]\\]', '', 'g') || chr(10) || chr(10) || ' ' || conv_id || ' x&y ' || trim(role) || ' ' || chr(10) || chr(10), '\\n{{2,}}', chr(10), 'g'), {}))"


@query(f"SELECT conv_id, turn, {EVALUATED.format(SPACES)} AS text FROM conversations")
def fn_eval_text(spark, sf_dir):
    """The measured text of a prediction: tables as their cells' texts, where they stand."""
    return _tagged(spark, sf_dir).select("conv_id", "turn", F.md5(c.evaluation_text("tagged")).alias("text"))


@query()
def fn_gt_text(spark, sf_dir):
    return _tagged(spark, sf_dir).select("conv_id", "turn", F.md5(c.truth_text("tagged")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE CAST(trim(text) <> '' AS INTEGER) END AS tables, CASE WHEN turn % 2 = 0 THEN role ELSE trim(text) END AS first FROM conversations")
def fn_multi_tables(spark, sf_dir):
    """Answers that number their tables, and others that are one table."""
    numbered = F.concat(F.lit("[TABLE_1] "), "role", F.lit("\n[/TABLE_1] and [TABLE_2]"), F.col("turn").cast("string"), F.lit("[/TABLE_2][TABLE_3] [/TABLE_3]"))
    tables = c.numbered_tables(F.when(F.col("turn") % 2 == 0, numbered).otherwise(F.col("text")))
    return _said(spark, sf_dir).select("conv_id", "turn", F.size(tables).alias("tables"), F.get(tables, F.lit(0)).alias("first"))


@query("SELECT page_id, len(regexp_extract_all(lower(html), '<tr[^>]*>')) >= 2 OR len(regexp_extract_all(lower(html), '<(?:td|th)[^>]*>')) >= 3 AS real_table FROM pages")
def flt_real_table(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", c.is_real_table(F.col("html")).alias("real_table"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) ELSE trim(role) || chr(10) || chr(10) || trim(text) END AS markdown FROM conversations")
def ar_markdown_value(spark, sf_dir):
    """Nested values: a known key's alone where there is one, else all."""
    known = F.to_json(F.struct(F.col("role").alias("other"), F.struct(F.col("text").alias("content")).alias("markdown")))
    every = F.to_json(F.struct(F.array("role").alias("a"), F.struct(F.col("text").alias("b"), F.lit(5).alias("n")).alias("c")))
    return _said(spark, sf_dir).select("conv_id", "turn", c.markdown_value(F.when(F.col("turn") % 3 == 0, known).otherwise(every)).alias("markdown"))


@query("SELECT conv_id, turn, '<p>' || role || '</p>' AS html, '| ' || turn || ' |' AS markdown, CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS images FROM conversations")
def fn_markers(spark, sf_dir):
    """The marked sections of a tagged text."""
    more = F.when(F.col("turn") % 2 == 0, "").otherwise("[[IMAGE id=b]]second[[/IMAGE]]")
    text = F.concat(F.lit("[[TABLE]]\n<p>"), "role", F.lit("</p>\n[[/TABLE]][[TABLE]] [[/TABLE]][[TABLE_MARKDOWN]]\n| "), F.col("turn").cast("string"), F.lit(" |\n[[/TABLE_MARKDOWN]][[IMAGE]]first[[/IMAGE]]"), more)
    rows = _said(spark, sf_dir).select("conv_id", "turn", text.alias("t"))
    return rows.select("conv_id", "turn", c.html_section(F.col("t")).alias("html"), c.markdown_section(F.col("t")).alias("markdown"), F.size(c.image_sections(F.col("t"))).alias("images"))


FLOWS = """SELECT user_id, list(event_type || ' ' || event_id ORDER BY event_id) AS steps FROM events GROUP BY 1"""


def _flows(spark, sf_dir):
    """Descriptions of flow charts: a user's events in order as nodes, an edge from each to the next."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.concat(e["event_type"], F.lit(" "), e["event_id"].cast("string")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(steps.alias("steps"))
    nodes = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("- "), F.replace(s, F.lit(" "), F.lit("  ")))), "\n")
    edges = F.array_join(F.zip_with(F.slice("steps", F.lit(1), F.size("steps") - 1), F.slice("steps", F.lit(2), F.size("steps")), lambda a, b: F.concat(F.lit("* "), a, F.lit(" → "), b, F.lit(" [next]"))), "\n")
    return rows.select("user_id", "steps", F.concat(F.lit("## 노드\n"), nodes, F.lit("\n## 엣지\n"), edges).alias("text"))


@query(f"SELECT user_id, len(steps) AS nodes, len(steps) - 1 AS edges, steps[1] AS first, CASE WHEN len(steps) > 1 THEN steps[len(steps)] END AS last FROM ({FLOWS})")
def fn_flow_parse(spark, sf_dir):
    nodes, edges = c.flow_nodes(F.col("text")), c.flow_edges(F.col("text"))
    return _flows(spark, sf_dir).select("user_id", F.size(nodes).cast("long").alias("nodes"), F.size(edges).cast("long").alias("edges"), F.get(nodes, F.lit(0)).alias("first"), F.get(edges, F.size(edges) - 1)["target"].alias("last"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(role) || ' [[TABLE]]' || turn || '[[/TABLE]] end' ELSE trim(role) || ' <표> end' || chr(10) || chr(10) || '[[IMAGE]]' || turn || '[[/IMAGE]]' END AS merged FROM conversations")
def jn_source_blocks(spark, sf_dir):
    """Source texts with the blocks that their marks stand for; blocks without a mark come after."""
    source = F.concat("role", F.lit(" <표> end"))
    kind = F.when(F.col("turn") % 2 == 0, "TABLE").otherwise("IMAGE")
    generated = F.concat(F.lit("text [["), kind, F.lit("]]"), F.col("turn").cast("string"), F.lit("[[/"), kind, F.lit("]]"))
    return _said(spark, sf_dir).select("conv_id", "turn", c.with_blocks(source, generated).alias("merged"))


@query(f"""SELECT doc_id, i AS page, md5(trim(array_to_string(ls[i * n + 1:(i + 1) * n], chr(10)), {SPACES})) AS text FROM (
    SELECT doc_id, ls, greatest(1, CAST(ceil(len(ls) / 3.0) AS INTEGER)) AS n, unnest([0, 1, 2]) AS i FROM (SELECT doc_id, string_split(trim(text, {SPACES}), chr(10)) AS ls FROM documents))""")
def win_page_paging(spark, sf_dir):
    """Texts in three pages each, by their lines."""
    pages = c.source_pages(F.col("text"), F.lit(3))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page", "t")).select("doc_id", "page", F.md5("t").alias("text"))


@query(f"""SELECT doc_id, CAST(coalesce(min(pos) FILTER (pos >= 1 AND (contains(t, 'DocInfo') OR length(t) > 50 AND (length(t) - length(replace(t, '#', ''))) * 1.0 / length(t) > 0.25 OR length(t) > 200 AND (length(t) - length(regexp_replace(t, '[가-힣]', '', 'g'))) * 1.0 / length(t) < 0.02)), count(*)) AS INTEGER) AS pages
    FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10))), {SPACES}) AS t FROM documents) GROUP BY 1""")
def flt_garbage_pages(spark, sf_dir):
    """Pages (lines here) before the first that is a dump of bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", c.sound_pages(F.split("text", "\n")).alias("pages"))
