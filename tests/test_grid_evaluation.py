"""Grids against true ones: each pair is made once, and headers of all kinds count as they did."""

from foliant.operators import matching as ma

TABLE = "id long, n int, rows long, cols long, header array<string>"


def tables(spark):
    headers = [None, [], ["a"], ["a", "a", "b"], ["b", None], ["c"]]
    predicted = spark.createDataFrame([(d, i, 2 + i, 3, h, i % 2, i != 3) for d in (1, 2) for i, h in enumerate(headers)] + [(4, 1, 2, 2, ["a"], 0, None)], TABLE + ", page int, valid boolean")
    truth = spark.createDataFrame([(d, i, 2 + i, 3, h, [i % 2]) for d in (1, 3) for i, h in enumerate(headers)], TABLE + ", pages array<int>")
    return predicted, truth


def test_a_document_is_evaluated_without_joining_its_tables_again(spark):
    got = ma.grid_evaluation(*tables(spark), "id")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {tuple(r) for r in got.collect()} == {(1, 6, 5, 6, 6, 5, 0.8333, 0.8333), (2, 6, 5, 0, 0, 0, 0.8333, None), (3, 0, 0, 6, 0, 0, None, 0.0), (4, 1, 0, 0, 0, 0, 0.0, None)}


def test_headers_are_alike_by_their_different_tokens(spark):
    def share(p, t):
        if not t:
            return 0.5
        p, t = set(p or []), set(t)
        return len(p & t) / len(p | t)

    rows = ma.candidates(*tables(spark), "id").filter("id = 1").collect()
    assert len(rows) == 36
    for r in rows:
        a, b = r.p.rows, r.t.rows
        size = 1 - abs(a - b) / max(a, b)
        assert abs(r.score - (0.35 * size + 0.35 + 0.2 * share(r.p.header, r.t.header) + 0.1 * (r.p.page in r.t.pages))) < 6e-5
