"""The queries of this subpackage over its intended tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, dedup, extract, langid, licenses, pii, topk, toxicity, warc
from foliant.llm.common import table


#: The languages of the table documents.
LANGUAGES = ("en", "de", "fr", "es")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, language, posterior, declared and kept."""
    return langid.identify(table(spark, sf_dir, "documents"), LANGUAGES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document: doc_id, held_out, score and predicted."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text and n_chars."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    return topk.threshold_topk(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0, k=10)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: doc_id, n_shingles, component_id and kept."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: The key of the surrogates where the session's setting PII_SETTING names none; a deployment sets a secret one.
PII_KEY, PII_SETTING = "foliant-public-key", "spark.foliant.piiKey"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_SETTING, PII_KEY)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in its text: doc_id and text."""
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents: doc_id, item_id and distance of each that is found."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in documents: doc_id, paragraph, family, probability and template_match of each."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document: doc_id, n_tokens, and digests of the ids and of what they decode to."""
    return bpe.digest_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a WARC archive, read back: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_main_text, op4_threshold_topk, op5_minhash_dedup, op6_pii_surrogates, op7_decontamination, op8_license_scan, op9_byte_bpe, op10_warc)}

ORACLE_SQL = {
    "op4_threshold_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT s0, min(doc_id) AS rep, any_value(s) AS s FROM (SELECT doc_id, s, list_sort(s) AS s0 FROM g WHERE len(s) > 0) GROUP BY s0),
        e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM u),
        p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS rep, min(b) AS comp FROM r GROUP BY a),
        f AS (SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(c.comp, g.doc_id) AS component_id
              FROM g LEFT JOIN u ON u.s0 = list_sort(g.s) AND len(g.s) > 0 LEFT JOIN c ON c.rep = u.rep)
        SELECT *, doc_id = component_id AS kept FROM f""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to FROM m""",
}
