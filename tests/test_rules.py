"""Small cases of rules that have no SQL, and edges of those that have."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import cleaning, jobs, matching, monitoring, regions, reports, retrieval, tables, text
from foliant.sources import store
from foliant.streaming import events, items


def packed(text_of, size=500, overlap=50):
    """Chunks by a plain loop: the units that fit, from the rule's words."""
    units = []
    for p in (p.strip() for p in text_of.split("\n\n")):
        if p and len(p) <= size:
            units.append(("\n\n", p))
        elif p:
            units += [(" " if i else None, w) for i, w in enumerate(p.split())]
    out = []
    for gap, u in units:
        if out and gap and len(out[-1]) + len(gap) + len(u) <= size:
            out[-1] += gap + u
        else:
            out.append(u)
    return [(out[i - 1][-overlap:] + "\n\n" if i and overlap else "") + c for i, c in enumerate(out)]


def test_chunks_keep_paragraphs_and_overlap(spark):
    cases = [("", 10, 0, []), ("a\n\nb", 10, 0, ["a\n\nb"]), ("aaaa bbbb cccc\n\ndd", 10, 0, ["aaaa bbbb", "cccc\n\ndd"]), ("x" * 30, 10, 0, ["x" * 30]), ("aaaaaa\n\nbbbbbb", 8, 3, ["aaaaaa", "aaa\n\nbbbbbb"]), (None, 10, 3, []), (" a \n\n\n\n b c ", 4, 1, ["a", "a\n\nb c"])]
    rng = random.Random(5)
    for _ in range(40):
        made = "".join(rng.choice(["a", "bb ", "ccc", " ", "\n", "\n\n", "d" * 12, "e f g "]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.choice([5, 9, 20]), rng.choice([0, 3])
        cases.append((made, size, overlap, packed(made, size, overlap)))
    for size, overlap in {c[1:3] for c in cases}:
        some = [c for c in cases if c[1:3] == (size, overlap)]
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(some)], "i int, t string")
        got = [r.c for r in df.select("i", text.chunks(F.col("t"), size, overlap).alias("c")).orderBy("i").collect()]
        assert got == [c[3] for c in some]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=12), st.text("ab ", max_size=12))
def test_nid_is_the_longest_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    want = 2 * rows[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert abs(text._nid(a, b) - want) < 1e-12


def test_grid_of_spans_and_nested_tables():
    g = tables.grid_of("<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert (g.rows, g.cols, g.problems) == (3, 2, [])
    assert [c.text for c in g.cells] == ["h", "ain", "b", "c"]
    assert "parse error" in tables.grid_of("<table><tr><td rowspan=x>a</td></tr></table>").problems
    assert tables.grid_of("").problems == ["no cells"]


A = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"


def test_match_of_structure():
    m = tables.match_score
    assert m(A, A) == 1.0 and m("", "") == 1.0 and m("", A) == m(A, "<table></table>") == 0.0
    # sizes 1, all cells but the heads' flags alike: cells 2 of 4, places all, heads none against two
    plain = A.replace("th>", "td>").replace("1", "7").replace("2", "8").replace("a<", "y<").replace("b<", "z<")
    assert abs(m(plain, A) - (0.15 + 0.45 * 0.5 + 0.30 + 0.0)) < 1e-12
    # the same texts lift the score to 0.92 at most
    assert m(A.replace("th>", "td>"), A) == 0.92
    # a row that is not closed is none, inner tables do not count, a span may reach past the end
    assert m("<table><tr><td>1</td>", "<table><tr><td>1</td></tr></table>") == 0.0
    inner = A.replace("<td>1</td>", "<td>1<table><tr><td>9</td></tr></table></td>")
    assert tables.places(inner).cells == tables.places(A).cells
    assert tables.places("<table><tr><td rowspan=3>x</td></tr></table>").size == (3, 1)
    assert tables.over_tables(m, [], [A]) == 0.0 and tables.over_tables(m, [A], []) is None
    assert tables.over_tables(m, [A], [A, A]) == 0.5


def test_edit_distance_of_tokens():
    assert tables.teds(A, A) == 1.0 and tables.teds("", "") == 1.0 and tables.teds("", A) == 0.0
    # 14 tags and 4 texts; another text in one cell, short texts alike in 3 of 4 characters
    other = A.replace(">2<", ">5<")
    assert abs(tables.teds(other, A) - max(1 - 1 / 18, 0.75)) < 1e-12
    assert tables.teds(other, A, texts=False) == 1.0
    # spans are part of a token, closing tags are tokens
    wide = A.replace("<td>2", "<td colspan=2>2")
    assert abs(tables.teds(wide, A, texts=False) - max(1 - 1 / 14, 0.92)) < 1e-12
    # equal texts in another structure are lifted to 0.92 without texts and to 1 with them
    rows = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in "ab12") + "</table>"
    assert tables.teds(rows, A) == 1.0 and tables.teds(rows, A, texts=False) == 0.92


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_edits_equal_the_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if not b else row
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert tables.edits(list(a), list(b)) == row[-1]


def test_cells_grids_and_analyses():
    assert tables.cell_accuracy([A], [A]) == (1.0, 1.0, 1.0) and tables.cell_accuracy([], [A]) == tables.cell_accuracy([A], []) == (0.0, 0.0, 0.0)
    assert tables.cell_accuracy([A.replace("1", "2")], [A]) == (0.75, 0.75, 0.75)
    assert tables.grid_fault(A) == "" and tables.grid_fault("") == "no rows" and tables.grid_fault("<tr><td rowspan=x></td></tr>") == "spans are no numbers"
    assert tables.grid_fault("<tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr>") == "cells overlap"
    assert tables.grid_fault("<tr><td>a</td><td>b</td></tr><tr><td>c</td></tr>") == "rows of different widths"
    got = tables.analyze(A.replace("<td>2", "<td rowspan=2>2"))
    assert (got["rows"], got["cols"], got["header_rows"], got["cells"], got["header_text"], got["valid"]) == (2, 2, 1, 4, "a | b", True)
    assert not tables.analyze(A.replace("<td>2", "<td rowspan=4>2"))["valid"] and tables.analyze("")["errors"] == ["no table"]
    assert tables.analyze(A.replace("<td>2", "<td rowspan=4>2"))["rows"] == 4
    assert tables.diagnostics("<table><tr><td>a</td><td rowspan=3>b</td></tr><tr></tr></table>") == [2, 2, 1, 1]
    assert tables.first_balanced("x<table><table></table></table>y") == "<table><table></table></table>"
    assert tables.first_balanced("<table>") == ""
    assert tables.merge_continued(A, A) == tables.to_html([["a", "b"], ["1", "2"], ["1", "2"]])


def test_matches_and_evaluations_equal_plain_loops(spark):
    from foliant.plans import tables as plans

    predicted, truth = plans._measured(spark, "/root/testdata/sf0.001")
    predicted, truth = predicted.filter("id < 1500").cache(), truth.filter("id < 1500").cache()
    scores = {}
    for r in matching.candidates(predicted, truth, "id").select("id", F.col("t.n").alias("t"), F.col("p.n").alias("p"), "score").collect():
        scores.setdefault(r.id, {})[r.t, r.p] = r.score
    want = set()
    for doc, some in scores.items():
        free = {p for _, p in some}
        for t in sorted({t for t, _ in some}):
            best = max(((some[t, p], -p) for p in free), default=None)
            if best:
                want.add((doc, t, -best[1], best[0]))
                free.discard(-best[1])
    assert {tuple(r) for r in matching.in_order(matching.candidates(predicted, truth, "id"), "id").collect()} == want
    p, t = {(r.id, r.n): r for r in predicted.collect()}, {(r.id, r.n): r for r in truth.collect()}
    for r in matching.grid_evaluation(predicted, truth, "id").collect():
        mine = [(p[d, b], t[d, a]) for d, a, b, _ in want if d == r.id]
        exact = sum(x.valid and x.rows == y.rows and x.cols == y.cols for x, y in mine)
        have = [x for (d, _), x in p.items() if d == r.id]
        asked = sum(d == r.id for d, _ in t)
        assert (r.predicted, r.valid, r.truth, r.matched, r.exact) == (len(have), sum(x.valid for x in have), asked, len(mine), exact)
        assert r.exact_rate == (round(exact / asked, 4) if asked else None)


def test_recompute_rules(spark):
    j = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, False), (6, False)], "job_id int, cancel_requested boolean")
    items = spark.createDataFrame([(1, "CANCELED"), (1, "CANCELED"), (2, "FAILED"), (3, "FAILED"), (3, "CANCELED"), (5, "COMPLETED"), (5, "QUEUED")], "job_id int, status string")
    got = {r.job_id: (r.status, r.progress) for r in jobs.recompute(j, items).collect()}
    assert got == {1: ("CANCELED", 100), 2: ("FAILED", 100), 3: ("COMPLETED", 100), 4: ("CANCELED", 100), 5: ("QUEUED", 50), 6: ("QUEUED", 0)}


def test_ownerless_rows_differ_between_views(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, owner string")
    assert [r.id for r in monitoring.owned_by(df, "a", "owner").collect()] == [1]
    assert sorted(r.id for r in monitoring.visible_to(df, "a", "owner").collect()) == [1, 2]
    assert monitoring.owned_by(df, None, "owner").count() == 3


def test_cosine_of_no_length(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.0, 2.0],)], "v array<double>")
    v = F.array(F.lit(0.0), F.lit(1.0))
    assert [r[0] for r in df.select(retrieval.cosine(F.col("v"), v)).collect()] == [0.0, 1.0]


def test_lives_over_micro_batches_equal_a_plain_fold(spark, tmp_path):
    """Events that arrive in several files and batches give what a fold of all of them gives."""
    rng = random.Random(11)
    kinds = ["STARTED", "PROGRESS", "PROGRESS", "RETRY_REQUESTED", "COMPLETED", "FAILED", "OTHER"]
    rows = [(rng.randrange(12), at, at, rng.choices(kinds, [4, 6, 6, 2, 1, 1, 1])[0], rng.choice([None, 7.5, 40.0, 120.0])) for at in range(0, 900, 3)]
    schema = "item_id long, at long, id long, kind string, value double"
    for i in range(0, len(rows), 75):
        spark.createDataFrame([*rows[i : i + 75], (None, 1, 1, "STARTED", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for ttl in (None, 60):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
        got = {r.item_id: tuple(r)[1:] for r in events.run_once(items.lives(stream, "item_id", ttl, 2), "update", ["item_id"]).collect()}
        want = {}
        for item, at, _, kind, value in rows:
            want[item] = items.step(want.get(item, items.Life()), at, kind, value, ttl, 2)
        assert got == {k: tuple(v) for k, v in want.items()}


def test_rules_of_lives():
    step = lambda life, at, kind, value=None: items.step(life, at, kind, value, 10, 1)
    claimed = step(items.Life(), 0, "STARTED")
    assert (claimed.status, claimed.progress, claimed.expires) == ("PROCESSING", 5, 10) and step(claimed, 1, "STARTED").refused == 1
    assert step(items.Life(), 0, "PROGRESS", 50).refused == 1
    renewed = step(claimed, 9, "PROGRESS", 50)
    assert (renewed.progress, renewed.expires) == (50, 19) and step(renewed, 12, "PROGRESS", 20).progress == 50
    timed_out = step(claimed, 11, "OTHER")
    assert (timed_out.status, timed_out.retries, timed_out.timeouts, timed_out.progress) == ("QUEUED", 1, 1, 0)
    over = step(step(timed_out, 12, "STARTED"), 30, "COMPLETED")
    assert (over.status, over.timeouts, over.late) == ("FAILED", 2, 1) and step(step(claimed, 3, "CANCELED"), 4, "COMPLETED").status == "CANCELED"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_cleaning_of_answers(spark):
    clean = lambda t: one(spark, t, cleaning.clean_answer)
    assert clean(None) is None and clean(" ") == " " and clean("plain") == "plain"
    assert clean("x\n```markdown\nfirst\n```\ny\n```\nlast one\n```") == "last one"
    assert clean("### 이미지 분석 및 유형 판단\n생각\n### 내용\n본문\n### 최종 확인\n끝") == "## 내용\n본문"
    assert clean("#### 1. 차트 유형 및 특징\n막대\n#### 2. 값\n3") == "## 2. 값\n3"
    assert clean("## 이미지 유형\n사진\n\n## 내용\nA\n\n## 부가 정보\n- 없음\n- 없음") == "## 내용\nA"
    assert clean("## 내용\nA\n## 부가 정보\n- 범례 있음") == "## 내용\nA\n## 부가 정보\n- 범례 있음"
    assert clean("## 데이터 표\n|a|\n## 시리즈 정보\nb\n## 데이터 상세 (인덱스별)\nc") == "## 데이터 표\n|a|"
    assert clean("## 시리즈 정보\nb\n\nc\nd") == "## 시리즈 정보\nb\n\nc\nd"
    assert clean("## ## 제목\na\nb\nc") == "## 제목\na\nb\nc"
    long = "# " * 200_000 + "x"
    assert clean(long).endswith("x")


def test_cleaning_of_texts(spark):
    assert one(spark, "단순 텍스트 문서입니다. 원문을 그대로 출력하겠습니다:\n A  b", cleaning.strip_meta) == "A b"
    assert one(spark, "&lt;b&gt; o A&amp;b <i>c</i> 참조 p 12", cleaning.plain_key) == "Abcp12참조"
    assert one(spark, "[[TABLE]]<b>가</b>&amp; A1[[/TABLE]]", cleaning.duplicate_key) == "가a1"
    assert one(spark, "<p>a<b>b</b></p>\n<script>x</script>c", cleaning.strip_html) == "a\nb\n\n\nc" and one(spark, "a < b", cleaning.strip_html) == "a < b"
    assert one(spark, "원본 파일: x\n페이지 수: 1\n---\n## Page 1\n[[TABLE]]\na  b\n\n\n\nc\n[[/TABLE]]", cleaning.plain_output) == "a b\n\nc"
    assert one(spark, "# T\n* a [x](y) | `z`\n1. b", cleaning.plain_reference) == "T\na x z\nb"
    tagged = "head\n## Page 1\nA\n[[TABLE]]<table><tr><td>1<br>2</td><td></td><th>x&amp;y</th></tr></table>[[/TABLE]]\n\n[[TABLE_MARKDOWN]]|1|[[/TABLE_MARKDOWN]]B"
    assert one(spark, tagged, cleaning.evaluation_text) == "A\n 1 2 x&y \nB"
    assert one(spark, tagged, cleaning.truth_text) == "A\n 1\n2 x&y \nB"
    for value, want in (('{"content": {"text": " ", "markdown": "# a|b"}}', "a b"), ('{"content": {"html": "<p>a</p><p>b&amp;</p>"}}', "a\nb&"), ("{}", ""), ('{"content": {"text": "x"}}', "x")):
        assert one(spark, value, cleaning.provider_text) == want
    assert cleaning.markdown_of({"a": ["x", {"text": " y "}], "b": 3, "c": "z"}) == "x\n\ny\n\nz" and cleaning.markdown_of({"a": "x", "content": "y"}) == "y"
    pairs = spark.createDataFrame([("a" * 100, "b" * 20 + "a" * 100), ("a" * 100, "b" * 100), ("a" * 70, "a" * 70), (None, None), ("ab" * 60, "ab" * 50 + "cd" * 10)], "a string, b string")
    assert [r.x for r in pairs.select(cleaning.repeats("a", "b").alias("x")).collect()] == [True, False, False, False, True]
    f1 = spark.range(1).select(cleaning.multiset_f1(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abb"))).alias("x")).first().x
    assert tuple(f1) == (0.6667, 0.6667, 0.6667)
    assert one(spark, "a\fb", lambda t: cleaning.source_pages(t, F.lit(2))) == ["a", "b"] and one(spark, None, lambda t: cleaning.source_pages(t, F.lit(2))) == ["", ""]


def test_geometry_of_tables():
    rects = [(0, 0, 50, 20), (50.5, 0, 100, 20.4), (0, 20, 100, 40)]
    cells = regions.cells_of(rects, [["a", "b"], ["c\nd", None]])
    assert [(c["row"], c["col"], c["rowspan"], c["colspan"], c["text"]) for c in cells] == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 2, "c\nd")]
    assert regions.cells_html(cells) == '<table><tr><th><p>a</p></th><th><p>b</p></th></tr><tr><td colspan="2"><p>c</p><p>d</p></td></tr></table>'
    assert regions.cells_of(rects[:0], [["a"]]) == [] and regions.cells_html([]) == ""
    grid = [("rect", 100, 100, 200, 150), ("rect", 200, 100, 300, 150), ("line", 0, 500, 5, 500), ("line", 0, 500, 30, 540)]
    assert regions.grid_regions(grid, [(110, 110, 120, 120)], 600, 800) == [(96, 96, 304, 154)]
    assert regions.grid_regions(grid, [], 600, 800) == [] and regions.grid_regions(grid[:1], [(110, 110, 120, 120)], 600, 800) == []
    assert regions.merged_regions([(0, 0, 10, 10), (15, 5, 30, 10), (100, 100, 110, 110)]) == [(0, 0, 30, 10), (100, 100, 110, 110)]
    frame = [("rect", 50, 50, 550, 700), ("line", 50, 300, 550, 300)]
    box, html = regions.container(frame, [((60, 60, 100, 80), "b  c\nd"), ((60, 55, 90, 58), "a"), ((70, 400, 80, 410), "in")], [((65, 390, 200, 450), "<table></table>")], 600, 800)
    assert box == (46, 46, 554, 704) and html == "<table><tr><td><p>a</p><p>b c</p><p>d</p></td></tr><tr><td><table></table></td></tr></table>"
    assert regions.container(frame[:1], [((60, 60, 100, 80), "b")], [], 600, 800) is None


def test_tables_take_the_place_of_their_texts():
    put = reports.tables_into_texts
    tables = [{"first_line": "never", "flat_text": "", "html": "A"}, {"first_line": "a b", "flat_text": "a b c d e f", "html": "B"}]
    assert put([("text", "x"), ("image", "i"), ("text", "a  b"), ("text", "c d e f" + " g" * 30), ("text", "h")], tables) == [("text", "x"), ("image", "i"), ("table", "B"), ("text", "h")]
    assert put([("text", " ")], tables) == [("text", " ")] and put([("text", "a b")], []) == [("text", "a b")]


def test_stores_of_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/B.PDF", b"x"), ("c.csv", b"12"), ("empty.csv", b""), (".d.csv", b"y"), ("e.txt", b"z"), ("a/.gitkeep", b"")], "path string, content binary")
    assert store.write_files(rows, f"file://{tmp_path}/f").count() == 6
    assert sorted((r.relative_path, r.suffix, r.size) for r in store.listing(spark, f"file://{tmp_path}/f").collect()) == [("a/B.PDF", "pdf", 1), ("c.csv", "csv", 2)]
    assert [r.relative_path for r in store.listing(spark, f"file://{tmp_path}/f", deep=False).collect()] == ["c.csv"]
    assert store.write_files(rows, f"file://{tmp_path}/f").count() == 6  # a second time replaces


def test_bare_tables():
    html, markdown, flat = tables.bare("x<table class=a><tr style=b><td rowspan='2' id=c>1 <b>&amp;</b></td><td>a|b</td></tr><tr><td> </td></tr><tr><td>z</td></tr></table><table></table>")
    assert html == '<table><tr><td rowspan="2">1 <b>&amp;</b></td><td>a|b</td></tr><tr><td> </td></tr><tr><td>z</td></tr></table>'
    assert (markdown, flat) == ("| 1 & | a\\|b |\n| --- | --- |\n| z |  |", "1 & a|b\nz") and tables.bare("") == ("", "", "")


def test_no_inputs_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        store.distinct_inputs(spark.createDataFrame([], "path string"), "path")
