"""Files, sinks, reports, schedules and page geometry, over files written from the test tables and over the tables themselves."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import regions as rg
from foliant.operators import reports as rp
from foliant.plans.bindings import records, table, with_records
from foliant.plans.layout import _boxes
from foliant.registry import query
from foliant.scratch import shared_path
from foliant.sources import store as st


def _written(spark, sf_dir):
    """A folder with a file for each nation, in a folder of its region or at the top; some are hidden or no inputs."""
    folder = shared_path(spark, "nations")
    k = F.col("n_nationkey")
    place = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/")))
    name = F.when(k % 7 == 6, F.concat(F.lit("."), "n_name", F.lit(".csv"))).otherwise(F.concat("n_name", F.when(k % 5 == 4, ".doc").when(k % 2 == 0, ".CSV").otherwise(".pdf")))
    rows = table(spark, sf_dir, "nation").select(F.concat(place, name).alias("path"), F.encode(F.col("n_name"), "UTF-8").alias("content"))
    st.write_files(rows, folder)
    return folder


NATIONS = "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'r' || n_regionkey || '/' END || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.CSV' ELSE '.pdf' END AS relative_path, CAST(length(n_name) AS BIGINT) AS size, CASE WHEN n_nationkey % 2 = 0 THEN 'csv' ELSE 'pdf' END AS suffix, n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 7 <> 6 AND n_nationkey % 5 <> 4"


@query(f"SELECT relative_path, size, suffix FROM ({NATIONS})")
def src_managed_list(spark, sf_dir):
    """Inputs below a folder with their sizes."""
    return st.listing(spark, _written(spark, sf_dir)).select("relative_path", "size", "suffix")


@query(f"SELECT relative_path FROM ({NATIONS})")
def src_dir_scan(spark, sf_dir):
    return st.listing(spark, _written(spark, sf_dir)).select("relative_path")


@query(f"SELECT relative_path, size FROM ({NATIONS}) WHERE k % 3 = 0 ORDER BY 1")
def src_eval_inputs(spark, sf_dir):
    """Inputs in a folder itself, in order."""
    return st.listing(spark, _written(spark, sf_dir), deep=False).select("relative_path", "size").orderBy("relative_path")


def _upper(content: bytes) -> str:
    if content.startswith(b"A"):
        raise ValueError("begins with A")
    return content.decode().lower()


@query("SELECT CASE WHEN n_name LIKE 'A%' THEN NULL ELSE lower(n_name) END AS text, CASE WHEN n_name LIKE 'A%' THEN 'ValueError: begins with A' END AS error FROM nation WHERE n_nationkey % 7 <> 6")
def src_process_dir(spark, sf_dir):
    """Every file below a folder converted; one that fails does not stop the others."""
    from foliant.sources.files import scan

    files = scan(spark, _written(spark, sf_dir)).filter("NOT contains(path, '/_written/')")
    return st.convert_all(files, _upper).select("text", "error")


@query("SELECT n_nationkey AS k, 'nation-' || n_nationkey || '.txt' AS path, CAST(length(n_name) AS BIGINT) AS bytes, '{\"pages\":1,\"name\":\"' || n_name || '\"}' AS meta FROM nation")
def sink_txt_meta(spark, sf_dir):
    """A text and its meta data for each document, written and read back."""
    folder = shared_path(spark, "texts")
    stem = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))
    meta = F.to_json(F.struct(F.lit(1).alias("pages"), F.col("n_name").alias("name")))
    both = table(spark, sf_dir, "nation").select(F.explode(F.array(F.struct(F.concat(stem, F.lit(".txt")).alias("path"), F.encode(F.col("n_name"), "UTF-8").alias("content")), F.struct(F.concat(stem, F.lit(".meta.json")).alias("path"), F.encode(meta, "UTF-8").alias("content")))).alias("f")).select("f.*")
    st.write_files(both, folder)
    files = spark.read.format("binaryFile").load(f"{folder}/nation-*").select(F.element_at(F.split("path", "/"), -1).alias("path"), "length", F.decode("content", "UTF-8").alias("text"))
    k = F.regexp_extract("path", r"nation-(\d+)", 1).cast("int")
    texts, metas = files.filter(F.endswith("path", F.lit(".txt"))).select(k.alias("k"), "path", F.col("length").alias("bytes")), files.filter(F.endswith("path", F.lit(".json"))).select(k.alias("k"), F.col("text").alias("meta"))
    return texts.join(metas, "k")


@query("SELECT n_regionkey AS archive, count(*) AS files, CAST(sum(length(n_name)) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def sink_zip(spark, sf_dir):
    """A ZIP archive of each region's files, written and opened again."""
    import io
    import zipfile

    import pandas as pd

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(set(rows["n_name"])):
                z.writestr(f"{name}.txt", name)
        return pd.DataFrame({"path": [f"r{rows['n_regionkey'].iloc[0]}.zip"], "content": [out.getvalue()]})

    folder = shared_path(spark, "archives")
    st.write_files(table(spark, sf_dir, "nation").select("n_regionkey", "n_name").groupBy("n_regionkey").applyInPandas(packed, "path string, content binary"), folder)

    def opened(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return f"{len(z.namelist())} {sum(len(z.read(n)) for n in z.namelist())}"

    files = st.convert_all(spark.read.format("binaryFile").load(f"{folder}/*.zip"), opened)
    part = lambda i: F.get(F.split("text", " "), F.lit(i)).cast("long")
    return files.select(F.regexp_extract("path", r"r(\d+)\.zip$", 1).cast("int").alias("archive"), part(0).alias("files"), part(1).alias("bytes"))


@query("SELECT source AS engine, '## 엔진: ' || source || chr(10) || chr(10) || '| 지표 | 값 |' || chr(10) || '|---|---|' || chr(10) || '| 파일 수 | ' || count(*) || ' (실패: ' || count(*) FILTER (lang = 'de') || ') |' || chr(10) || '| 평균 글자 | ' || coalesce(CAST(max(n_chars) FILTER (lang = 'xx') AS VARCHAR), 'N/A') || ' |' AS text FROM documents GROUP BY 1")
def sink_report(spark, sf_dir):
    """The sections of a report, a table of measures for each engine."""
    sums = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("engine")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "de").alias("failed"), F.max(F.when(F.col("lang") == "xx", F.col("n_chars"))).alias("none"))
    return rp.report_lines(sums, "engine", {"파일 수": F.format_string("%d (실패: %d)", "n", "failed"), "평균 글자": rp.shown(F.col("none"))})


@query(with_records("SELECT job_id, CASE WHEN contains(model, ',') THEN '\"' || model || '\"' ELSE model END || ',' || job_id || ',' || coalesce(owner, '') || ',' || created_at AS line, printf('%.2f', created_at / 100.0) AS seconds FROM job_records", "job_records"))
def sink_bench(spark, sf_dir):
    """Lines of the benchmark's CSV, and its seconds as the report shows them."""
    c = F.col
    return records(spark, sf_dir, "job_records").select("job_id", rp.csv_line([c("model"), c("job_id"), c("owner"), c("created_at")]).alias("line"), rp.seconds(c("created_at") * 10).alias("seconds"))


@query(with_records("""SELECT e.event_id, e.event_type, coalesce(c.total, 0) AS total, coalesce(c.finished, 0) AS finished, CAST(coalesce(floor(c.finished * 100.0 / c.total), 0) AS BIGINT) AS percent FROM event_records e
    LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELED')) AS finished FROM item_records GROUP BY 1) c ON c.job_id = e.job_id WHERE e.event_type IN ('VIEW', 'PROGRESS', 'RETRY_REQUESTED', 'FAILED', 'SIGNUP')""", "event_records", "item_records"))
def sink_event(spark, sf_dir):
    """What subscribers get for each event: of its type, and how far its job is."""
    out = rp.event_messages(records(spark, sf_dir, "event_records").select("event_id", "event_type", "job_id"), records(spark, sf_dir, "item_records"))
    return out.select("event_id", "event_type", "total", "finished", F.col("percent").cast("long").alias("percent"))


@query("SELECT coalesce(c.k, s.k) AS key, CASE WHEN coalesce(c.dirty, false) THEN c.v ELSE s.v END AS value FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 <> 0 THEN 'new' || c_custkey END AS v, c_custkey % 4 = 0 AS dirty FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0) s ON c.k = s.k WHERE CASE WHEN coalesce(c.dirty, false) THEN c.v ELSE s.v END IS NOT NULL")
def src_kv_backends(spark, sf_dir):
    """Entries through a cache before a store: customers of even keys are cached, every second of these dirty, some deleted."""
    k, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    cached = customer.filter(k % 2 == 0).select(k.alias("key"), F.when(k % 8 != 0, F.concat(F.lit("new"), k.cast("string"))).alias("value"), (k % 4 == 0).alias("dirty"))
    return st.read_through(cached, customer.filter(k % 3 == 0).select(k.alias("key"), F.col("c_name").alias("value")), "key")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'hwpx' WHEN 1 THEN 'hwp5' WHEN 2 THEN 'legacy' ELSE 'unknown' END AS kind FROM pages")
def src_hwp_version(spark, sf_dir):
    """The kind of word processor files by their first bytes."""
    head = F.when(F.col("page_id") % 4 == 0, F.unhex(F.lit("504B0304"))).when(F.col("page_id") % 4 == 1, F.unhex(F.lit(st.OLE))).when(F.col("page_id") % 4 == 2, F.encode(F.lit("HWP Document File V3.00 \x1a"), "ISO-8859-1")).otherwise(F.encode(F.lit("HWP Document"), "ISO-8859-1"))
    return table(spark, sf_dir, "pages").select("page_id", st.processor_kind(F.concat(head, F.encode("html", "UTF-8"))).alias("kind"))


@query("SELECT l_orderkey, list_reduce(list_prepend([]::BIGINT[], list([l_partkey % 6] ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a WHEN len(a) = 3 THEN list_append(a[2:], x[1]) ELSE list_append(a, x[1]) END) AS held FROM lineitem GROUP BY 1")
def lim_fifo_cache(spark, sf_dir):
    """What a cache of three holds after each order's parts were asked for."""
    asked = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda x: x["l_partkey"] % 6)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(asked.alias("asked")).select("l_orderkey", rp.fifo(F.col("asked"), 3).alias("held"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def dt_now_iso(spark, sf_dir):
    """Instants as the records hold them; now is passed as a column, so that a run can be repeated."""
    return table(spark, sf_dir, "events").select("event_id", rp.iso(F.col("ts")).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN true WHEN a <= b THEN m BETWEEN a AND b ELSE m >= a OR m <= b END AS inside FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, event_id % 24 * 60 + event_id % 60 AS a, event_id * 7 % 24 * 60 + event_id * 13 % 60 AS b FROM events)")
def dt_window(spark, sf_dir):
    """Whether events lie in windows of the day, some over midnight, some that are no times."""
    i = F.col("event_id")
    start = F.when(i % 11 == 0, "25:00").otherwise(F.format_string("%02d:%02d", i % 24, i % 60))
    return table(spark, sf_dir, "events").select("event_id", rp.in_window(F.col("ts"), start, F.format_string("%d:%02d", i * 7 % 24, i * 13 % 60)).alias("inside"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 = 0 THEN least(greatest(1, CASE WHEN s_suppkey % 13 > 0 THEN least(s_suppkey % 13 * 2, 16) ELSE 4 END), 8) ELSE least(CASE WHEN s_suppkey % 13 > 0 THEN least(s_suppkey % 13 * 2, 16) ELSE 4 END, greatest(1, s_suppkey % 40 // 2), 16) END AS INTEGER) AS workers FROM supplier")
def ma_parallel(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", rp.parallelism(k % 13, F.when(k % 5 != 0, k % 40)).alias("workers"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0.0::DOUBLE ELSE round(s_nationkey::DOUBLE / (s_suppkey % 9) * 100, 2) END AS percent FROM supplier")
def agg_disk(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", rp.usage_percent(F.col("s_nationkey"), F.col("s_suppkey") % 9).alias("percent"))


@query("SELECT conv_id, turn, n - 1 AS page, '<table>' || n || '</table>' AS html FROM (SELECT conv_id, turn, unnest([2, 3]) AS n FROM conversations)")
def tb_extract(spark, sf_dir):
    """The tables of tagged texts with their pages."""
    text = F.lit("head\n## Page 1\n[[TABLE]]\n<table>2</table>\n[[/TABLE]]\n\ntext\n## Page 2\n x\n[[TABLE]]\n<table>3</table>\n[[/TABLE]]\n[[TABLE]] no [[/TABLE]]\n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(rp.tables_by_page(F.concat(F.lit("a\n"), text))).alias("t"))
    return rows.select("conv_id", "turn", "t.page", "t.html")


@query(with_records("SELECT document_id, status, attempts FROM (SELECT document_id, CASE WHEN document_id % 4 < 3 THEN 'done' ELSE 'failed' END AS status, least(document_id % 4, 2) + 1 AS attempts, row_number() OVER (ORDER BY document_id) AS n FROM doc_records WHERE status IS NULL AND document_id % 5 <> 0)", "doc_records"))
def st_poll_batch(spark, sf_dir):
    """A poll of what is not yet processed: each document is tried three times at most; outside its window nothing runs."""
    waiting = records(spark, sf_dir, "doc_records").filter("status IS NULL")
    open_now = rp.in_window(F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), F.when(F.col("document_id") % 5 == 0, "22:00").otherwise("08:00"), F.when(F.col("document_id") % 5 == 0, "06:00").otherwise("18:00"))
    fails = F.col("document_id") % 4  # attempts that fail before one succeeds
    return waiting.filter(open_now).select("document_id", F.when(fails < 3, "done").otherwise("failed").alias("status"), (F.least(fails, F.lit(2)) + 1).alias("attempts"))


def _drawn(spark, sf_dir):
    """Pages of rectangles and texts: an order's unreturned lines are drawn, the others are texts."""
    boxes = _boxes(spark, sf_dir).select("page", F.struct("element", "x0", "y0", "x1", "y1", "kind").alias("b"))
    return boxes.groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("boxes"))


def _split(page: dict) -> tuple[list, list]:
    box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
    return [("rect", *box(b)) for b in page["boxes"] if b["kind"] == "N"], [box(b) for b in page["boxes"] if b["kind"] != "N"]


@query()
def tb_grid_regions(spark, sf_dir):
    """Regions of ruled grids with a text at them, overlapping ones joined."""
    def found(page):
        return [(page["page"], i, *map(float, r)) for i, r in enumerate(rg.merged_regions(rg.grid_regions(*_split(page), 1000.0, 1200.0)))]

    return rg.pages(_drawn(spark, sf_dir), "page long, region int, x0 double, y0 double, x1 double, y1 double", found)


@query()
def tb_container(spark, sf_dir):
    """The frame around most of a page with bands between its lines, with the page's texts in them."""
    def found(page):
        drawn, texts = _split(page)
        top, end = 40.0, 1100.0
        frame = [("rect", 20.0, top, 980.0, end), ("line", 20.0, 400.0, 980.0, 400.0), *drawn]
        got = rg.container(frame, [(b, f"t{i}\nx") for i, b in enumerate(texts)], [], 1000.0, 1200.0)
        return [(page["page"], *map(float, got[0]), got[1])] if got else []

    return rg.pages(_drawn(spark, sf_dir), "page long, x0 double, y0 double, x1 double, y1 double, html string", found)


GRID = "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS row, l_returnflag AS a, l_linestatus AS b FROM lineitem"


def _grids(spark, sf_dir):
    """An order's lines as rows of two cells; of every second row the first cell spans both columns."""
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), row.alias("row"), "l_returnflag", "l_linestatus")
    return rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row", "l_returnflag", "l_linestatus"))).alias("rows"))


def _cells(page: dict) -> list[dict]:
    rects = []
    for r in (x["row"] for x in page["rows"]):
        y = 10.0 + 20 * r
        rects += [(10.0, y, 110.3, y + 20.4)] if r % 2 else [(10.2, y, 60.0, y + 20.1), (60.4, y, 110.0, y + 20.0)]
    return rg.cells_of(rects, [[x["l_returnflag"], x["l_linestatus"]] for x in page["rows"]])


@query(f"SELECT page, row, 0 AS col, CASE WHEN row % 2 = 1 AND n > 0 THEN 2 ELSE 1 END AS colspan, a AS text FROM (SELECT *, max(row) OVER (PARTITION BY page) AS m, 1 AS n FROM ({GRID})) UNION ALL SELECT page, row, 1, 1, b FROM ({GRID}) WHERE row % 2 = 0")
def tb_cells_meta(spark, sf_dir):
    """Cells from rectangles that nearly meet: row, column and span by the lines on which their sides lie."""
    return rg.pages(_grids(spark, sf_dir), "page long, row int, col int, colspan int, text string", lambda page: [(page["page"], c["row"], c["col"], c["colspan"], c["text"]) for c in _cells(page)])


@query(f"SELECT page, md5('<table>' || string_agg('<tr>' || CASE WHEN row % 2 = 1 THEN '<td colspan=\"2\"><p>' || a || '</p></td>' WHEN row = 0 THEN '<th><p>' || a || '</p></th><th><p>' || b || '</p></th>' ELSE '<td><p>' || a || '</p></td><td><p>' || b || '</p></td>' END || '</tr>', '' ORDER BY row) || '</table>') AS html FROM ({GRID}) GROUP BY 1")
def tb_cells_html(spark, sf_dir):
    """The same cells as a table."""
    return rg.pages(_grids(spark, sf_dir), "page long, html string", lambda page: [(page["page"], rg.cells_html(_cells(page)))]).select("page", F.md5("html").alias("html"))


@query("SELECT conv_id, count(*) AS elements, count(*) FILTER (turn % 2 = 0) AS tables FROM conversations GROUP BY 1")
def jn_hwpx_text(spark, sf_dir):
    """Turns as texts of a page, of which every second is a table's text: the tables take their places."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def merged(page):
        elements = [("text", f"turn {t['turn']}: {t['text']}") for t in page["turns"]]
        tables = [{"first_line": f"turn {t['turn']}: {t['text']}", "flat_text": "", "html": f"<table>{t['turn']}</table>"} for t in page["turns"] if t["turn"] % 2 == 0]
        out = []
        for kind, content in elements:  # each text is a page's only one, so a table stands where its text was
            got = rp.tables_into_texts([(kind, content)], tables)
            tables = tables[1:] if got[0][0] == "table" else tables
            out += got
        return [(page["conv_id"], len(out), sum(k == "table" for k, _ in out))]

    return rg.pages(turns, "conv_id long, elements long, tables long", merged)


@query(f"SELECT relative_path FROM ({NATIONS}) n WHERE NOT EXISTS (SELECT 1 FROM nation o WHERE o.n_nationkey % 4 = 0 AND o.n_name = n.n_name)")
def src_dir_unprocessed(spark, sf_dir):
    """Inputs without an output in the folder of the same place: every fourth nation has one."""
    k, out = F.col("n_nationkey"), shared_path(spark, "outputs")
    place = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/")))
    made = table(spark, sf_dir, "nation").filter(k % 4 == 0).select(F.concat(place, "n_name", F.lit(".txt")).alias("path"), F.encode(F.col("n_name"), "UTF-8").alias("content"))
    return st.unprocessed(st.listing(spark, _written(spark, sf_dir)).select("relative_path"), st.write_files(made, out).withColumnRenamed("path", "relative_path"))


@query("SELECT n_name AS stem, CASE WHEN n_nationkey % 4 <> 3 THEN n_name || '.pdf' END AS file, n_nationkey % 4 <> 3 AS valid FROM nation")
def src_gt(spark, sf_dir):
    """Ground truths by stem; every second has another one further on, every fourth lacks its file."""
    k, folder = F.col("n_nationkey"), shared_path(spark, "truths")
    one = F.when(k % 4 != 3, F.to_json(F.struct(F.concat("n_name", F.lit(".pdf")).alias("file")))).otherwise(F.to_json(F.struct(F.array().alias("blocks"))))
    nations = table(spark, sf_dir, "nation")
    files = nations.select(F.concat(F.lit("a/"), "n_name", F.lit(".json")).alias("path"), F.encode(one, "UTF-8").alias("content"))
    later = nations.filter(k % 2 == 0).select(F.concat(F.lit("b/"), "n_name", F.lit(".json")).alias("path"), F.encode(F.lit('{"file": "later"}'), "UTF-8").alias("content"))
    st.write_files(files.unionByName(later), folder)
    return st.ground_truths(spark, folder).select("stem", "file", "valid")


@query("SELECT DISTINCT regexp_extract(url, '^[^?#]*') AS path FROM pages")
def src_bench_inputs(spark, sf_dir):
    """Inputs by resolved path, each once; none is an error."""
    return st.distinct_inputs(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^?#]*", 0).alias("path")), "path")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def sink_audit(spark, sf_dir):
    """A log after two appends."""
    log = shared_path(spark, "audit")
    st.append(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), log)
    return st.append(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), log)


@query("SELECT l_orderkey AS id, count(*) FILTER (l_tax > 0.02) AS rows, 'part state' || coalesce(chr(10) || string_agg(l_partkey || ' ' || l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_suppkey, l_quantity) FILTER (l_tax > 0.02), '') AS flat FROM lineitem GROUP BY 1")
def tb_hwp_html(spark, sf_dir):
    """Tables without attributes but spans, and their texts row by row."""
    from foliant.operators import tables as tb
    from foliant.plans.tables import _tables

    styled = F.replace("truth", F.lit("<td"), F.lit("<td style='x' class=y"))
    rows = _tables(spark, sf_dir).select("id", tb.udf_of(lambda h: [*tb.bare(h)], "1:array<string>")(styled).alias("x"))
    return rows.select("id", F.regexp_count(F.get("x", F.lit(0)), F.lit("<tr><td(?: colspan=.2.)?>")).cast("long").alias("rows"), F.get("x", F.lit(2)).alias("flat"))
