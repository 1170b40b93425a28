"""Tables by whole columns: what comes out row by row, with the work of a form done once."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators import forms, tables
from test_larger import MADE

ROWS = st.lists(st.tuples(st.none() | MADE, st.none() | MADE), max_size=8)


def column(values):
    """The values as a slice of a longer column."""
    return pa.array(["<td>x", *values, "y&"], pa.string()).slice(1, len(values))


@settings(max_examples=200, deadline=None)
@given(ROWS)
def test_columns_come_out_as_row_by_row(rows):
    a, b = ([x or "" for x in some] for some in zip(*rows)) if rows else ([], [])
    p, t = (column([row[i] for row in rows]) for i in (0, 1))
    as_list = lambda x: x if isinstance(x, list) else x.to_pylist()
    for function, keep in [(tables.held_and_cells, forms.nothing), (tables.grid_fault, forms.nothing), (tables.diagnostics, forms.nothing), (tables.size_facts, forms.blank_or_not), (tables.markdown_size, forms.rulers_and_bars)]:
        assert forms.by_form(function, keep)(p) == [function(x) for x in a]
    assert as_list(forms.to_markdown(p)) == [tables.to_markdown(x) for x in a]
    assert forms.cell_accuracy(p, t) == [[*tables.cell_accuracy([x], [y])] for x, y in zip(a, b)]
    assert forms.lifting(forms.by_form(tables.match_of_tags), tables.match_score)(p, t) == [tables.match_score(x, y) for x, y in zip(a, b)]
    s = lambda x, y: tables.teds(x, y, texts=False)
    assert forms.lifting(forms.by_form(tables.teds_of_tags), s)(p, t) == [s(x, y) for x, y in zip(a, b)]


def plain(i):
    return f"<table><tr><td colspan={1 + i % 2}>{i}</td><td>é{i}</td></tr></table>"


def test_a_form_is_worked_out_once_for_a_column():
    calls = []

    def cells(html):
        calls.append(html)
        return html.count("<td")

    assert forms.by_form(cells)(pa.array([plain(i) for i in range(1_000)] + ["<td>&amp;", None])) == [2] * 1_000 + [1, 0]
    assert len(calls) == 4 and "<td>&amp;" in calls


def test_no_plain_table_is_cut_by_itself(monkeypatch):
    cut = []
    tables._parts.cache_clear()
    parts = tables._parts
    monkeypatch.setattr(tables, "_parts", lambda html: cut.append(html) or parts(html))
    a, b = (pa.array([plain(i + d) for i in range(1_000)]) for d in (0, 1))
    for f in (forms._template, forms._single_cells, forms._outcome):
        f.cache_clear()
    assert forms.cell_accuracy(a, a) == [[1.0] * 3] * 1_000 and forms.cell_accuracy(a, b) == [[0.0] * 3] * 1_000
    assert forms.to_markdown(a)[7].as_py() == tables.to_markdown(plain(7)) == "| 7 |  | é7 |\n| --- | --- | --- |"
    assert forms.lifting(forms.by_form(tables.match_of_tags), tables.match_score)(a, a) == [1.0] * 1_000
    assert len(cut) < 40


def test_texts_are_compared_only_where_lengths_let_them_be_alike(monkeypatch):
    asked = []
    whole = forms.common_subsequence
    monkeypatch.setattr(forms, "common_subsequence", lambda a, b: asked.append((a, b)) or whole(a, b))
    made = lambda *cells: "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>"
    p, t = [made("abcdefgh"), made("a" * 90, "b" * 10)], [made("abcdefgh", "ijklmnop", "q"), made("a" * 90)]
    scored = forms.lifting(forms.by_form(tables.match_of_tags), tables.match_score)(pa.array(p), pa.array(t))
    assert scored == [tables.match_score(x, y) for x, y in zip(p, t)]
    assert asked == [("a" * 90 + "b" * 10, "a" * 90)]
