"""Language identification by Bayesian evidence fusion.

log P(language | everything) = text likelihood + declared language + host prior, where
- the text likelihood is a trigram model over hashed UTF-8 trigrams, counted over all rows by their declared language;
- P(declared | language) is counted over all rows, with the text's own posterior as weights;
- the host prior is smoothed towards that of its address suffix, which is smoothed towards that of the whole corpus;
  all three are grouped sums of the text's posterior.
A class for no language ("und") has uniform trigrams, so unlike text goes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, stored

#: Values of trigram hashes; trigrams of a text that count as independent evidence; pseudo-counts of the smoothing.
BUCKETS, EVIDENCE, GRAM_PRIOR, HOST_PRIOR = 4096, 60.0, 0.5, 20.0
#: Characters of texts whose trigrams are in memory at once.
PART_CHARS = 1 << 18
#: Share of the class "und" before any evidence.
UND_SHARE = 0.001
UND = "und"
#: Hosts whose priors are broadcast; of more, rows and priors are joined by a shuffle.
BROADCAST_HOSTS = 200_000

#: Bytes that are no letters count as spaces.
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts one after another, and how many each text has; those of spaces alone are left out."""
    parts = [f"  {text.lower()} ".encode() if text else b"" for text in texts]
    raw = _PLAIN[np.frombuffer(b"".join(parts), np.uint8)]
    if len(raw) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    code = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    keep = code != 0x202020
    for last in ends[sizes > 0] - 1:  # no trigram reaches into the next text
        keep[max(0, last - 1) : last + 1] = False
    counts = np.concatenate([[0], np.cumsum(keep)])
    ends = np.minimum(ends, len(code))
    per_text = np.diff(np.concatenate([[0], counts[ends]]))
    return (code[keep] * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64), per_text


def parts_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Where to cut a batch so that a part has PART_CHARS at most, or one longer text; bounds the memory of trigrams."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > PART_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def gram_counts(docs: DataFrame, text_col: str, declared_col: str, languages: tuple[str, ...]) -> np.ndarray:
    """Counts of each hashed trigram by declared language, over all rows; languages x BUCKETS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            at = np.array([languages.index(x) if x in languages else -1 for x in batch.column(1).to_pylist()], np.int64)
            texts = batch.column(0).to_pylist()
            for i, j in parts_of(texts):
                grams, sizes = trigrams(texts[i:j])
                of = np.repeat(at[i:j], sizes)
                total += np.bincount(of[of >= 0] * BUCKETS + grams[of >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    found = only(docs, text_col, declared_col).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(languages) * BUCKETS)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out.reshape(len(languages), BUCKETS)


def likelihoods(counts: np.ndarray):
    """An Arrow function of a text: grams, and ll, the log likelihood of each language and of "und", as if of EVIDENCE
    trigrams at most. Texts go to Python and do not come back."""
    model = np.log((counts + GRAM_PRIOR) / (counts + GRAM_PRIOR).sum(axis=1, keepdims=True)).astype(np.float32)
    model = np.vstack([model, np.full(BUCKETS, -np.log(BUCKETS), np.float32)])

    def of_part(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        grams, sizes = trigrams(texts)
        ends = np.cumsum(sizes)
        sums = np.empty((len(model), len(sizes)))
        for i, row in enumerate(model):
            running = np.concatenate([[0.0], np.cumsum(row[grams], dtype=np.float64)])
            sums[i] = running[ends] - running[ends - sizes]
        return sizes, (sums * np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))).T

    @F.arrow_udf("grams long, ll array<double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            sizes, sums = (np.concatenate(x) for x in zip(*([of_part(texts[i:j]) for i, j in parts_of(texts)] or [of_part([])])))
            ll = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(model), dtype=np.int32), sums.ravel())
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), ll], ["grams", "ll"])

    return scored


def text_scores(docs: DataFrame, carried: list[str], text_col: str, declared_col: str, host_col: str, languages: tuple[str, ...], counts: np.ndarray) -> DataFrame:
    """row (the carried columns of docs), declared ("" for no known language), host, grams and ll."""
    text, declared, host = (F.col(f"`{c}`").cast("string") for c in (text_col, declared_col, host_col))
    row = F.struct(*[F.col(f"`{c}`") for c in carried])
    rows = docs.select(row.alias("row"), F.when(declared.isin(*languages), declared).otherwise("").alias("declared"), host_of(host).alias("host"), likelihoods(counts)(text).alias("x"))
    return rows.select("row", "declared", "host", "x.grams", "x.ll")


def host_of(address: Column) -> Column:
    """The host of an address: without scheme, user, port and path, in lower case; an empty one for null."""
    return F.coalesce(F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+)$", 1)


def judged(docs: DataFrame, carried: list[str], languages: tuple[str, ...], text_col: str, declared_col: str, host_col: str) -> DataFrame:
    """row (the carried columns of docs), language, posterior and declared for every row. Three passes read the texts: one
    counts trigrams, one what the texts say by host and declared language, one decides; none is stored or shuffled."""
    bound_batches(docs.sparkSession)
    classes, n = (*languages, UND), len(languages)
    counts = gram_counts(docs, text_col, declared_col, languages)
    scores_of = lambda some: text_scores(docs, some, text_col, declared_col, host_col, languages, counts)

    def shares(ll: Column) -> Column:
        """What a text alone says of the languages."""
        top = F.array_max(ll)
        return F.get(F.transform(F.array(F.transform(ll, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), F.lit(0))

    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    said = scores_of([declared_col]).filter("grams > 0").select("declared", "host", shares(F.slice("ll", 1, n)).alias("t"))
    solid = stored(said.groupBy("declared", "host").agg(*[F.sum(F.get("t", F.lit(i))).alias(f"s{i}") for i in range(n)]).withColumn("suffix", suffix_of(F.col("host"))), "evidence")
    whole = [x or 0.0 for x in solid.groupBy().agg(*sums).first()]
    overall = [(x + 1.0) / (sum(whole) + n) for x in whole]
    said = {r["declared"]: [r[f"s{i}"] for i in range(n)] for r in solid.groupBy("declared").agg(*sums).collect()}  # a row for each known language and ""
    declared_given = {d: [float(np.log((x + 1.0) / (whole[i] + n + 1.0))) for i, x in enumerate(said.get(d) or [0.0] * n)] for d in (*languages, "")}

    def smoothed(over: list[Column]) -> list[Column]:
        """The shares of a group, drawn to those of what it is part of."""
        all_of = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(n)])
        return [(F.col(f"s{i}") + F.lit(HOST_PRIOR) * over[i]) / (all_of + F.lit(HOST_PRIOR)) for i in range(n)]

    by_suffix = solid.groupBy("suffix").agg(*sums).select("suffix", *[x.alias(f"u{i}") for i, x in enumerate(smoothed([F.lit(x) for x in overall]))])
    by_host = solid.groupBy("host", "suffix").agg(*sums).join(by_suffix, "suffix").select("host", F.array(*[F.log(x) for x in smoothed([F.col(f"u{i}") for i in range(n)])]).alias("h"))
    by_host = stored(by_host, "host-priors")
    by_host = F.broadcast(by_host) if by_host.count() <= BROADCAST_HOSTS else by_host.hint("merge")
    numbers = lambda some: F.array(*[F.lit(float(x)) for x in some])
    given = F.element_at(F.create_map(*[x for d, some in declared_given.items() for x in (F.lit(d), numbers([*some, np.log(UND_SHARE)]))]), F.col("declared"))
    prior = F.concat(F.coalesce("h", numbers(np.log(overall))), numbers([-np.log(n + 1)]))
    scores = F.zip_with(F.zip_with("ll", given, lambda a, b: a + b), prior, lambda a, b: a + b)

    def decide(s: Column) -> Column:
        top = F.array_max(s)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct(F.element_at(F.array(*map(F.lit, classes)), F.array_position(s, top).cast("int")).alias("language"), F.round(1 / total, 6).alias("posterior"))

    found = F.when(F.col("grams") > 0, F.get(F.transform(F.array(scores), decide), F.lit(0))).otherwise(F.struct(F.lit(UND).alias("language"), F.lit(1.0).alias("posterior")))
    out = scores_of(carried).join(by_host, "host", "left").select("row", "declared", found.alias("found"))
    return out.select("row", "found.language", "found.posterior", "declared")


def identify(docs: DataFrame, languages: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """id, language, posterior, declared, kept (whether a language was found) for every row.

    A null, empty or letterless text has no language: "und", posterior 1.0 and not kept. Null or unknown declared languages
    are a value of their own, null addresses a host of their own. Repeated rows give repeated results; ties go to the
    language named first; other columns are not read. Priors of hosts are broadcast if counted to be few; beyond that ids
    and scores, never texts, are joined to them by a shuffle.
    """
    out = judged(docs, [id_col], languages, text_col, declared_col, host_col)
    return out.select(F.col("row").getField(id_col).alias(id_col), "language", "posterior", "declared", (F.col("language") != UND).alias("kept"))


def in_languages(docs: DataFrame, languages: tuple[str, ...], text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages; the declared language becomes the one found.

    Every row is judged by itself, as identify() does: null, empty and letterless texts go, whatever the id. Only with
    more than BROADCAST_HOSTS hosts rows are shuffled, by host, where Spark splits a hot one."""
    kept = judged(docs, docs.columns, languages, text_col, declared_col, host_col).filter(F.col("language") != UND)
    return kept.select(*[F.col("language").alias(c) if c == declared_col else F.col("row").getField(c).alias(c) for c in docs.columns])
