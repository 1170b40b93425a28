"""The pipeline's stages on a small table whose fate is known, with an extra column and a null id."""

import random

import corpus_pipeline
from foliant.llm.common import stored


def test_stages(spark):
    rng = random.Random(9)
    words = "the of and to in that was with this from".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "ing", "er", "s"]) + str(rng.choice("abcdefgh")) for _ in range(n))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    base = prose(80)
    rows = [(1, base, "en", "src1", 1), (2, base, "en", "src1", 1), (3, base + " one more", "en", "src2", 1), (4, prose(60) + " " + bench + " " + prose(20), "en", "src2", 1), (5, prose(60) + " mail me at a.b@mail1.example.com " + prose(9), "en", None, 1), (6, None, "en", "src1", None), (7, "", None, "src1", 0), (8, "12 !! 34", "en", "src1", 8), (None, prose(70), "en", "src1", 1)]
    rows += [(i, prose(60), "en", "src1", 1) for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, language string")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "encoding":
            assert docs.columns == before
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 5, None, *range(10, 40)}
    assert "a.b@" not in got[5].text and got[5].n_chars == len(got[5].text)
    assert all(r.n_tokens == len(r.token_ids) > 0 for r in got.values())


def test_rows_without_an_id_or_that_repeat_one(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("the of and to in that was".split()) + rng.choice("abcdefgh") for _ in range(n))
    one, two, three = prose(60), prose(60), prose(60)
    rows = [(None, None), (None, "12 !! 34 99"), (None, one), (None, two), (5, one), (5, two), (5, "1234 5678"), (5, three), (5, three), (7, two + " more"), (8, "")]
    rows += [(i, prose(50)) for i in range(20, 50)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spoken = stored(corpus_pipeline.language_stage(spark, docs, ""), "spoken")
    assert spoken.columns == docs.columns and {r.lang for r in spoken.collect()} == {"en"}
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.text) for r in spoken.collect()), key=key) == sorted(((i, t) for i, t in rows if t and any(c.isalpha() for c in t)), key=key)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, spoken, "").collect()]
    assert sorted(kept[:], key=key) == sorted([(5, one), (5, two), (5, three), *rows[11:]], key=key)


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.isEmpty()


def test_the_plan_of_the_language_stage_stays_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = corpus_pipeline.language_stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert len(stage) < 20_000
