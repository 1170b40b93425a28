"""Tables in HTML made from the lines of orders, predicted and true ones: a row for each line, with a heading row.

The true table of an order has its lines taxed above two percent, the predicted one those with a discount. The lines that
were returned take two columns with their part, and the last cell of the last row holds rows past the end by the line's number,
so some tables are unsound."""

from pyspark.sql import functions as F

from foliant.operators import forms as fo
from foliant.operators import matching as ma
from foliant.operators import tables as tb
from foliant.plans.bindings import table
from foliant.registry import query

IN_ORDER = "l_linenumber, l_partkey, l_returnflag, l_linestatus, l_suppkey, l_quantity"
HEAD = "<tr><th>part</th><th colspan=2>state</th></tr>"


def _lines(spark, sf_dir):
    """id and rows: an order's lines in order, each with the HTML of its cells, and whether it is true and predicted."""
    cell = lambda c, attrs="": F.concat(F.lit("<td"), F.lit(attrs) if isinstance(attrs, str) else attrs, F.lit(">"), F.col(c).cast("string"), F.lit("</td>"))
    wide = F.when(F.col("l_returnflag") == "R", " colspan=2").otherwise("")
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity", F.concat(cell("l_partkey"), cell("l_returnflag")).alias("plain"), F.concat(cell("l_partkey", wide), cell("l_returnflag")).alias("wide"), (F.col("l_tax") > 0.02).alias("true"), (F.col("l_discount") > 0).alias("predicted"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("rows"))


def _html(rows, cells: str, past_end: bool = False):
    """The table of some lines; if so said, the last cell of the last row spans rows past the end."""
    n = F.size(rows)
    down = lambda r, i: F.when((i == n - 1) & F.lit(past_end), F.concat(F.lit(" rowspan="), (1 + r["l_linenumber"] % 4).cast("string"))).otherwise("")
    each = F.transform(rows, lambda r, i: F.concat(F.lit("<tr>"), r[cells], F.lit("<td"), down(r, i), F.lit(">"), r["l_linestatus"], F.lit("</td></tr>")))
    return F.concat(F.lit(f"<table>{HEAD}"), F.array_join(each, ""), F.lit("</table>"))


def _tables(spark, sf_dir):
    """id, truth and predicted."""
    return _lines(spark, sf_dir).select("id", _html(F.filter("rows", lambda r: r["true"]), "wide", True).alias("truth"), _html(F.filter("rows", lambda r: r["predicted"]), "wide").alias("predicted"))


def _plain(spark, sf_dir):
    """id and truth, of all lines, without spans below the heading."""
    return _lines(spark, sf_dir).select("id", _html(F.col("rows"), "plain").alias("truth"))


FACTS = "(SELECT l_orderkey AS id, count(*) FILTER (l_tax > 0.02) AS n, count(*) FILTER (l_tax > 0.02 AND l_returnflag = 'R') AS r, coalesce(max(l_linenumber) FILTER (l_tax > 0.02), 0) % 4 AS q FROM lineitem GROUP BY 1)"


@query(f"SELECT id, n + 1 + CASE WHEN q >= 2 THEN q - 1 ELSE 0 END AS rows, CASE WHEN r > 0 THEN 4 ELSE 3 END AS cols, 2 + 3 * n AS cells, q < 2 AS valid FROM {FACTS}")
def tb_analyze_html(spark, sf_dir):
    """Size, cells and soundness of every true table, by laying texts over the places that cells span."""
    at = lambda i: F.get("x", F.lit(i))
    return _tables(spark, sf_dir).select("id", fo.udf_of(fo.by_form(tb.size_facts, fo.blank_or_not), "array<long>")("truth").alias("x")).select("id", at(0).alias("rows"), at(1).cast("int").alias("cols"), at(2).alias("cells"), (at(3) == 1).alias("valid"))


@query(f"SELECT count(*) AS total, count(*) FILTER (r = 0) AS valid, count(*) FILTER (r > 0) AS invalid, round(count(*) FILTER (r = 0) * 1.0 / count(*), 4)::DOUBLE AS score FROM {FACTS}")
def tb_grid_valid(spark, sf_dir):
    """Tables whose rows all hold equally many places, and their share."""
    return tb.validation(_tables(spark, sf_dir).select(fo.udf_of(fo.by_form(tb.grid_fault), "string")("truth").alias("fault")), "fault").drop("faults")


@query(f"SELECT id, CASE WHEN r > 0 THEN 'rows of different widths' ELSE '' END AS fault FROM {FACTS}")
def agg_grid_validation(spark, sf_dir):
    """What is wrong with each table."""
    return _tables(spark, sf_dir).select("id", fo.udf_of(fo.by_form(tb.grid_fault), "string")("truth").alias("fault"))


@query("""WITH c AS (SELECT l_orderkey AS id, unnest([CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus]) AS x, l_tax > 0.02 AS t, l_discount > 0 AS p FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, unnest(['part', 'state']), true, true FROM lineitem),
    s AS (SELECT id, x, count(*) FILTER (t) AS t, count(*) FILTER (p) AS p FROM c GROUP BY 1, 2),
    f AS (SELECT id, sum(least(t, p))::DOUBLE AS b, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p FROM s GROUP BY 1)
    SELECT id, round_even(b / p, 4) AS precision, round_even(b / t, 4) AS recall, round_even(2 * b / (p + t), 4) AS f1 FROM f""")
def tb_accuracy(spark, sf_dir):
    scored = fo.udf_of(fo.cell_accuracy, "array<double>", 2)("predicted", "truth")
    return _tables(spark, sf_dir).select("id", scored.alias("x")).select("id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("precision", "recall", "f1"))])


@query()
def tb_match(spark, sf_dir):
    """Likeness of structure of every predicted table to the true one."""
    scored = fo.lifting(fo.by_form(tb.match_of_tags), tb.match_score)
    return _tables(spark, sf_dir).select("id", fo.udf_of(lambda p, t: [round(x, 4) for x in scored(p, t)], "double", 2)("predicted", "truth").alias("score"))


@query()
def tb_teds(spark, sf_dir):
    return _tables(spark, sf_dir).select("id", tb.udf_of(lambda p, t: tb.over_tables(tb.teds, [p], [t]), "double")("predicted", "truth").alias("teds"))


@query()
def tb_teds_s(spark, sf_dir):
    scored = fo.lifting(fo.by_form(tb.teds_of_tags), lambda p, t: tb.teds(p, t, texts=False))
    return _tables(spark, sf_dir).select("id", fo.udf_of(scored, "double", 2)("predicted", "truth").alias("teds_s"))


@query(f"""SELECT l_orderkey AS id, '| part | state |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_partkey || ' | ' || l_returnflag || ' | ' || l_linestatus || ' |', chr(10)
    ORDER BY {IN_ORDER}) AS markdown FROM lineitem GROUP BY 1""")
def fn_md_table(spark, sf_dir):
    return _plain(spark, sf_dir).select("id", F.replace(fo.udf_of(fo.to_markdown, "string")("truth"), F.lit("|" + " --- |" * 3), F.lit("| --- | --- | --- |")).alias("markdown"))


@query(f"""SELECT l_orderkey AS id, md5('<table><tr><th>part</th><th>state</th><th></th></tr>' || string_agg('<tr><td>' || l_partkey || '</td><td>' || l_returnflag || '</td><td>' || l_linestatus || '</td></tr>', '' ORDER BY {IN_ORDER}) || '</table>') AS merged FROM lineitem GROUP BY 1""")
def tb_merge(spark, sf_dir):
    """A table of an order's first three lines and one of the rest, under the same heading, made one again."""
    part = lambda first: _html(F.filter("rows", lambda r: (r["l_linenumber"] <= 3) if first else (r["l_linenumber"] > 3)), "plain")
    halves = _lines(spark, sf_dir).select("id", part(True).alias("a"), part(False).alias("b"))
    return halves.select("id", F.md5(tb.udf_of(tb.merge_continued, "string")("a", "b")).alias("merged"))


@query("SELECT l_orderkey AS id, count(*) % 3 <> 0 AS whole FROM lineitem GROUP BY 1")
def fn_balanced_table(spark, sf_dir):
    """The first table of a text with all that is nested in it; every third is cut off before its end."""
    rows = _lines(spark, sf_dir).select("id", F.size("rows").alias("n"), _html(F.col("rows"), "plain").alias("t"))
    nested = F.concat(F.lit("<table><tr><td>"), "t", F.lit("</td></tr></table>"))
    text = F.when(F.col("n") % 3 != 0, F.concat(F.lit("x "), nested, F.lit(" y <table>"))).otherwise(F.concat(F.lit("x <table><tr><td>"), "t"))
    return rows.select("id", (tb.udf_of(tb.first_balanced, "1:string")(text) == nested).alias("whole"))


@query(f"SELECT id, CASE WHEN n > 0 THEN n + 1 ELSE 1 END AS rows, CASE WHEN r > 0 THEN 4 ELSE 3 END AS cols, CASE WHEN r > 0 THEN n + 1 - r ELSE 0 END AS incomplete, CAST(q > 0 AS INTEGER) AS overflowing FROM {FACTS}")
def tb_diagnostics(spark, sf_dir):
    """Rows, columns, rows that are not as wide as the table, and cells that span past its end."""
    at = lambda i: F.get("x", F.lit(i))
    return _tables(spark, sf_dir).select("id", fo.udf_of(fo.by_form(tb.diagnostics), "array<long>")("truth").alias("x")).select("id", at(0).alias("rows"), at(1).cast("int").alias("cols"), at(2).alias("incomplete"), at(3).cast("int").alias("overflowing"))


@query(f"SELECT id, 3 + 3 * n + r + q AS places, 2 + 3 * n AS anchors FROM {FACTS}")
def win_rowspan_fill(spark, sf_dir):
    """Places that a table's cells hold, rows and columns that spans fill included."""
    places = fo.udf_of(fo.by_form(tb.held_and_cells), "array<long>")("truth")
    return _tables(spark, sf_dir).select("id", places.alias("x")).select("id", F.get("x", F.lit(0)).alias("places"), F.get("x", F.lit(1)).alias("anchors"))


@query("SELECT l_orderkey AS id, count(*) + 1 AS rows, 3 AS cols FROM lineitem GROUP BY 1")
def tb_analyze_md(spark, sf_dir):
    at = lambda i: F.get("x", F.lit(i))
    return _plain(spark, sf_dir).select("id", fo.udf_of(fo.by_form(tb.markdown_size, fo.rulers_and_bars), "array<long>")("truth").alias("x")).select("id", at(0).alias("rows"), at(1).cast("int").alias("cols"))


def _measured(spark, sf_dir):
    """Predicted tables (lines with a discount) and true ones (taxed above two percent) of each order, numbered in order."""
    number = F.row_number().over(_by_order())
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), number.alias("n"), F.col("l_quantity").cast("long").alias("rows"), (F.col("l_partkey") % 5).alias("cols"), F.array_distinct(F.array("l_returnflag", "l_linestatus")).alias("header"), (F.col("l_suppkey") % 3).alias("page"), F.transform(F.sequence(F.lit(0), (F.col("l_linenumber") % 2).cast("int")), lambda i: (F.col("l_linenumber") + i) % 3).alias("pages"), (F.col("l_returnflag") != "R").alias("valid"), "l_tax", "l_discount")
    return lines.filter("l_discount > 0").drop("l_tax", "l_discount", "pages"), lines.filter("l_tax > 0.02").drop("l_tax", "l_discount", "page", "valid")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


MEASURED = """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n, CAST(l_quantity AS BIGINT) AS rows, l_partkey % 5 AS cols,
    list_distinct([l_returnflag, l_linestatus]) AS header, l_suppkey % 3 AS page, CASE WHEN l_linenumber % 2 = 0 THEN [l_linenumber % 3] ELSE [l_linenumber % 3, (l_linenumber + 1) % 3] END AS pages, l_returnflag <> 'R' AS valid, l_tax, l_discount FROM lineitem"""
SIZE = "CASE WHEN p.{0} > 0 AND t.{0} > 0 THEN 1 - abs(p.{0} - t.{0})::DOUBLE / greatest(p.{0}, t.{0}) ELSE 1.0 END"
LIKENESS = f"round(CAST(0.35::DOUBLE * ({SIZE.format('rows')}) + 0.35 * ({SIZE.format('cols')}) + 0.2::DOUBLE * len(list_intersect(p.header, t.header)) / len(list_distinct(list_concat(p.header, t.header))) + 0.1 * CAST(list_contains(t.pages, p.page) AS INTEGER) AS DECIMAL(18, 10)), 4)"


@query(f"WITH m AS ({MEASURED}) SELECT t.id, t.n AS truth, p.n AS predicted, CAST({LIKENESS} AS DOUBLE) AS score FROM m t JOIN m p ON p.id = t.id WHERE t.l_tax > 0.02 AND p.l_discount > 0")
def ma_table_score(spark, sf_dir):
    """Likeness of each true table to each predicted one of its document."""
    return ma.candidates(*_measured(spark, sf_dir), "id").select("id", F.col("t.n").alias("truth"), F.col("p.n").alias("predicted"), "score")


@query()
def jn_table_greedy(spark, sf_dir):
    """One predicted table for each true one, in the order of the true ones."""
    return ma.in_order(ma.candidates(*_measured(spark, sf_dir), "id"), "id")


@query()
def agg_grid_eval(spark, sf_dir):
    return ma.grid_evaluation(*_measured(spark, sf_dir), "id")


@query(f"""WITH m AS ({MEASURED}), h AS (SELECT t.id, t.n AS truth, coalesce(p.rows = t.rows AND p.cols = t.cols, false) AS same, coalesce(len(list_intersect(p.header, t.header)) * 1.0 / len(list_distinct(list_concat(p.header, t.header))) >= 0.5, false) AS alike, p.valid
        FROM m t LEFT JOIN m p ON p.id = t.id AND p.l_discount > 0 WHERE t.l_tax > 0.02 AND len(t.pages) > 1)
    SELECT id, truth, count(*) FILTER (same OR alike) AS candidates, count(*) FILTER (same AND valid) = 1 AS merged FROM h GROUP BY 1, 2""")
def agg_multipage_eval(spark, sf_dir):
    return ma.multipage_evaluation(*_measured(spark, sf_dir), "id")
