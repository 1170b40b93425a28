"""Queries and operators on rows that the smallest tables do not have."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant import registry
from foliant.operators import regions, tables, text

registry.load()


def test_all_documents_are_sorted(spark, tmp_path):
    spark.range(10_500).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 50 AS int) AS p_size", "900.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.QUERIES["srt_documents"](spark, str(tmp_path)).collect()
    assert len(rows) == 10_500
    assert rows == sorted(rows, key=lambda r: (-r.last_at, -r.document_id))


TAGS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<tr><td>", "</td><td>", "</td></tr>", "<td rowspan=2>", "<td colspan=\"2\">", "<th rowspan='3' class=\"a b\">", "<b>", "</p>", "<td rowspan=>", "<td rowspan>", "<TD>", "<td/>", "<br>", "<!-- x -->", "&amp;", "&lt", "<", ">", "a", "1 ", " \n", "|", "\\", "-", "é가", "```html"]
MADE = st.lists(st.sampled_from(TAGS), max_size=14).map("".join) | st.lists(st.sampled_from(TAGS[:15] + ["a", "1 ", "-", "|", " "]), max_size=20).map(lambda x: "<table>" + "".join(x) + "</table>")


def outcomes(a, b):
    """What every function says of two tables."""
    out = []
    for f in (tables.grid_of, tables.analyze, tables.grid_fault, tables.diagnostics, tables.to_markdown, tables.bare, tables.plain_key, tables.cell_texts, lambda h: tables.sizes(h).items() & {k: v for k, v in tables.analyze(h).items() if k not in ("errors", "header_text")}.items(), lambda h: vars(tables.places(h)), lambda h: tables.markdown_grid(h)):
        out.append(f(a))
    return [*out, tables.match_score(a, b), tables.teds(a, b), tables.teds(a, b, texts=False), tables.cell_accuracy([a], [b]), tables.merge_continued(a, b)]


@settings(max_examples=300, deadline=None)
@given(MADE, MADE)
def test_plain_tables_come_out_as_through_the_parser(a, b):
    got = outcomes(a, b)
    assert len(tables.sizes(a)) and all(tables.sizes(a)[k] == tables.analyze(a)[k] for k in ("rows", "cols", "header_rows", "cells", "valid"))
    plain, tables._parts = tables._parts, lambda html: None
    try:
        assert got == outcomes(a, b)
    finally:
        tables._parts = plain


def test_tables_of_the_same_tags_are_parsed_once(monkeypatch):
    feeds = []
    monkeypatch.setattr(tables._Tags, "feed", lambda self, html: feeds.append(html))
    a, b = "<table><tr><td colspan=2>1</td></tr></table>", "<table><tr><td colspan=2>7</td></tr></table>"
    tables._kept.cache_clear()
    assert [tables.cell_texts(a), tables.cell_texts(b), tables.diagnostics(a), tables.grid_fault(b)] == [["1"], ["7"], [1, 2, 0, 0], ""]
    assert feeds == [] and tables._kept.cache_info().hits >= 1


def test_distances_in_and_beyond_every_band(spark):
    n = [0, 1, 15, 16, 17, 63, 64, 65, 255, 256, 257, 400]
    rows = spark.createDataFrame([(k, "aB" * 300, "aB" * 300 + "x" * (k // 2), "y" * (k - k // 2)) for k in n], "k int, a string, b string, lead string")
    got = rows.select("k", text.distance(F.col("a"), F.concat("lead", "b")).alias("d")).collect()
    assert [r.d for r in got] == n
    assert spark.range(1).select(text.distance(F.lit(None).cast("string"), F.lit("a")).alias("d")).first().d is None


def test_lines_are_found_and_cells_covered_without_looking_at_all(monkeypatch):
    lines = [0.0, 2.0, 5.0]
    assert [regions.nearest(lines, v) for v in (-1, 0, 1, 1.1, 3.5, 3.6, 5, 9)] == [0, 0, 0, 1, 1, 2, 2, 2]
    monkeypatch.delattr(regions.np, "argmin")
    assert regions.nearest(lines, 4.0) == 2
    cell = lambda row, col, down, right: {"row": row, "col": col, "rowspan": down, "colspan": right, "text": f"{row}{col}"}
    assert regions.cells_html([cell(0, 0, 2, 1), cell(0, 1, 1, 1), cell(1, 0, 1, 1), cell(1, 1, 1, 1)]) == '<table><tr><th rowspan="2"><p>00</p></th><th><p>01</p></th></tr><tr><td><p>11</p></td></tr></table>'
