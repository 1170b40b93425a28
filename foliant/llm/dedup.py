"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A signature has SYMBOLS symbols of 16 bits in CHUNKS chunks of four. Two signatures that differ in at most
MAX_DISTANCE = 2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a chunk that differs in one symbol at most. So
each document is indexed under every chunk with each one of its symbols left out: all pairs within the distance meet
under a key. So do most beyond it, and they are not sent away: a pair at a similarity of exactly 0.75, whose symbols
differ with probability 0.25, meets under no key with a chance of 0.262 ** 16, about 5e-10.

Texts of equal sets are one node. Within a key not all pairs are verified: every node is compared with one hub, links
found make components, and only keys that still hold several components are looked at again, each node with the closest
one of another component. At last all pairs of different components that are left are verified. Pairs that cannot be
similar by their sizes or by the parity bits of their sets, which bound from below in how many shingles two sets differ,
are ruled out inside the group of a key. So every pair that meets is ruled out for certain, compared on its full sets,
or known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.llm.common import bound_batches, drop, release, stored
from foliant.llm.components import components
from foliant.llm.shingles import common, mix, shingle_set

SYMBOLS, CHUNKS = 64, 16
MAX_DISTANCE = 2 * CHUNKS - 1
#: Rounds of comparing with the closest of other components before all pairs that are left are compared.
CLOSEST_ROUNDS = 2
#: Rows of a key that are compared with each other at once; larger keys are cut into blocks that meet in pairs.
BLOCK_ROWS = 1024
#: Least and most parity bits of a set.
LEAST_BITS, MOST_BITS = 512, 8_192
#: Ids that are broadcast to pick texts or rows; of more, texts and ids are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Percent of the union that two sets must share.
PERCENT = 75

_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least of each of 64 permutations, four to a 64-bit integer."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, i : i + 2048] * _FACTOR + _SHIFT).min(axis=1))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of 512 to 8,192 classes of shingles (four for each shingle, or more): whether the class has an odd
    number. Sets whose bits differ in d places differ in d shingles at least, so the bits only rule out what is unlike."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * max(1, len(shingles)) - 1).bit_length()))
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def digest(shingles: np.ndarray) -> np.ndarray:
    """128 bits for a set, as two integers."""
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, first: Column) -> DataFrame:
    """doc (the id), at (a number of the row's own), first (what orders the rows of a component), n (size of the set), h1, h2
    (a digest of the set), sig and bits for every row of docs, stored."""
    bound_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures, bits = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                some = shingle_set(text.as_py() or b"")
                sizes.append(len(some))
                digests.append(digest(some))
                signatures.append(signature(some) if len(some) else np.empty(0, np.int64))
                bits.append(parity(some) if len(some) else b"")
            h1, h2 = np.array(digests, np.int64).reshape(-1, 2).T
            made = [pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), pa.array(signatures, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc", "first", "n", "h1", "h2", "sig", "bits"])
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), first.alias("first"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL("n long, h1 long, h2 long, sig array<long>, bits binary").fields])
    return stored(rows.mapInArrow(sketch, schema).withColumn("at", F.monotonically_increasing_id()), "sketches")


def index_keys(nodes: DataFrame) -> DataFrame:
    """key, p, node: each chunk of the signature with each one of its four symbols left out, the p-th of these patterns."""
    masks = [-1 - (0xFFFF << 16 * i) for i in range(3)] + [(1 << 48) - 1]
    parts = [F.xxhash64(F.lit(4 * c + i), F.get("sig", F.lit(c)).bitwiseAND(F.lit(m).cast("long"))) for c in range(CHUNKS) for i, m in enumerate(masks)]
    return nodes.select(F.posexplode(F.array(*parts)).alias("p", "key"), "node").withColumn("p", F.col("p").cast("byte"))


@F.arrow_udf(StructType([StructField("h1", LongType()), StructField("h2", LongType())]))
def digest_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The digest of a text's set. Texts go to Python and do not come back."""
    for batch in batches:
        h1, h2 = np.array([digest(shingle_set(text.as_py() or b"")) for text in batch.cast(pa.binary())], np.int64).reshape(-1, 2).T
        yield pa.StructArray.from_arrays([pa.array(h1), pa.array(h2)], ["h1", "h2"])


def texts_of(nodes: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """node and text, one for each of nodes (node, doc, h1, h2), stored. texts: doc, text; where ids are repeated, that row of
    an id is taken whose set has the node's digest."""
    if not repeated:
        return stored(texts.join(few(nodes.select("doc", "node")), "doc").select("node", "text"), "pair-texts")
    some = texts.join(few(nodes.select("doc").distinct()), "doc", "left_semi").withColumn("h", digest_of("text"))
    sure = lambda c: F.coalesce(c, F.lit(0)).alias(c.partition(".")[2])  # noqa: E731  never null, or the join's test for nulls works the digest out again
    return stored(some.select("doc", "text", sure("h.h1"), sure("h.h2")).join(nodes, ["doc", "h1", "h2"]).select("node", "text").dropDuplicates(["node"]), "pair-texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int = PERCENT, repeated: bool = True) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets share percent of their union. texts: doc, text.

    Texts go through the shuffle, not their sets, which are several times larger. Rows of one b come together, so its
    set is made once for each of them; Spark splits a hot b.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(nodes.select("node", "doc", "h1", "h2").join(wanted, "node", "left_semi"), "pair-nodes")
    some = texts_of(wanted, texts, repeated)
    rows = pairs.join(some.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(some.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if b != last:
                    last, last_set = b, shingle_set(text_b.as_py())
                one = shingle_set(text_a.as_py())
                both = common(one, last_set)
                keep.append(100 * both >= percent * (len(one) + len(last_set) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    links = stored(rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "links")
    drop(wanted, some)
    return links


def few(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if they are counted to be few, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def members(base: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """h1, h2 and first (that of its component's first row) of all sets of base (sketches) that have copies or links."""
    nodes = base.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("at", "doc", "n", "sig", "bits")).alias("x"), F.min("first").alias("first"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("h1", "h2", "copies", "first", F.col("x.at").alias("node"), "x.doc", "x.n", "x.sig", "x.bits"), "nodes")
    repeated = not base.groupBy("doc").count().filter("count > 1").isEmpty()
    links = linked(nodes, texts, percent, repeated)
    labels = components(links) if links is not None else nodes.limit(0).select("node", F.col("node").alias("component"))
    known = nodes.join(labels, "node", "left").filter("copies > 1 OR component IS NOT NULL").select("h1", "h2", "first", F.coalesce("component", "node").alias("component"))
    known = stored(known, "members")
    whole = known.groupBy("component").agg(F.min("first").alias("first"))
    return known.select("h1", "h2", "component").join(whole, "component").select("h1", "h2", "first")


def linked(nodes: DataFrame, texts: DataFrame, percent: int, repeated: bool) -> DataFrame | None:
    """Links (a, b) that connect all nodes whose sets share percent of their union and that meet under a key; None without.

    Each turn compares nodes of different components alone, and keys whose rows are in one component are done."""
    keys = index_keys(nodes)
    first = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("b")).filter("c > 1").select("key", "b")
    open_rows = stored(keys.join(first.hint("merge"), "key").withColumn("label", F.col("node")), "shared-keys")
    links = tried = None
    for turn in range(CLOSEST_ROUNDS + 2):
        if turn == 0:
            met = open_rows.filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("c"))
            pairs = met.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
        elif turn <= CLOSEST_ROUNDS:
            pairs = met_in_keys(open_rows, nodes, percent, closest=True).groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
        else:
            pairs = met_in_keys(open_rows, nodes, percent, closest=False)
        pairs = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = confirmed(pairs, nodes, texts, percent, repeated)
        links = new if links is None else links.unionByName(new)
        if turn > CLOSEST_ROUNDS:
            drop(open_rows)
            break
        labels = stored(components(links), "labels")
        rows = open_rows.select("key", "p", "node").join(labels.select("node", F.col("component").alias("label")), "node", "left").select("key", "p", "node", F.coalesce("label", "node").alias("label"))
        before, rows = open_rows, stored(rows, "open-rows")
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        open_rows = stored(rows.join(mixed, "key"), "open-rows")
        drop(before, rows, labels)
        if open_rows.isEmpty():
            break
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links, its own included) and kept for every row.

    Texts are linked when their sets of five-word shingles share percent of their union. A null or blank text has no
    shingles, is linked with nothing and is a component of its own. Rows without an id take no part: their component is
    null and they are kept. Rows that repeat an id are results each, every one of its own text's component.
    """
    base = sketches(docs, id_col, text_col, F.struct(F.col(f"`{id_col}`").cast("long").alias("doc")))
    known = members(base.filter("doc IS NOT NULL"), texts_by(docs, id_col, text_col), percent)
    out = base.select("doc", "n", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("first.doc", "doc")).otherwise(F.col("doc"))
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))


def texts_by(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component: the one of the smallest id stays, any one of rows
    that repeat this id; rows without an id are compared too and come after all others. Rows whose text has no words stay.

    Rows are told apart by a number of their own, never by the id; docs is copied once with it. The numbers of rows that go
    are broadcast if few."""
    numbered = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("number", F.monotonically_increasing_id()), "numbered")
    field = F.col("row").getField
    rows = numbered.select("number", field(text_col).alias("text"), field(id_col).alias("id"))
    base = sketches(rows, "number", "text", F.struct(F.col("id").isNull().alias("no_id"), "id", "number"))
    known = members(base, texts_by(rows, "number", "text"), percent)
    gone = base.filter("n > 0").select("doc", "h1", "h2").join(known, ["h1", "h2"]).filter(F.col("doc") != F.col("first.number"))
    return numbered.join(few(stored(gone.select(F.col("doc").alias("number")), "gone")), "number", "left_anti").select("row.*")


def met_in_keys(open_rows: DataFrame, nodes: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a key and whose sizes and bits similar sets can have, with the
    share d of bits that differ: all of them, each from the first key that it shares; or for each document and key the
    closest of another component.

    In a key most rows are of one component, as a rule; they are not compared with each other. Its rows go to one block
    of BLOCK_ROWS each, and meet all blocks of the key's other rows there; those also meet each other. So a key of n rows
    is shuffled once if others than its main component's fill a block at most. Only what is asked for leaves a block."""
    counts = open_rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("rows"))
    sizes = sizes.select("key", F.col("main.label").alias("main"), F.ceil((F.col("rows") - F.col("main.c")) / BLOCK_ROWS).cast("int").alias("others"), F.ceil(F.col("main.c") / BLOCK_ROWS).cast("int").alias("mains"))
    rows = open_rows.select("key", "p", "node", "label").join(sizes.hint("merge"), "key").join(nodes.select("node", "n", "sig", "bits").hint("merge"), "node")
    is_main, number = F.col("label") == F.col("main"), F.xxhash64("node")
    mine = F.when(is_main, F.col("others") + F.pmod(number, F.col("mains"))).otherwise(F.pmod(number, F.col("others"))).cast("int")
    partners = F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(partners))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label", "n", "p", F.col("others").alias("_others"), "sig", "bits")
    grouped = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            i, j, mine, doc, label, n, p, others = (group.column(c).to_numpy() for c in range(1, 9))
            sig = group.column(9).combine_chunks().flatten().to_numpy().view(np.uint16).reshape(len(doc), SYMBOLS)
            bits = Bits(group.column(10).to_pylist())
            left, right = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
            sides = [(left, right), (right, left)] if closest and i[0] != j[0] and j[0] < others[0] else [(left, right)]
            found: list[np.ndarray] = []
            for some, partners in sides:
                for at in some:
                    near = partners if closest or i[0] != j[0] else partners[doc[partners] > doc[at]]
                    near = near[(label[near] != label[at]) & (100 * np.minimum(n[near], n[at]) >= percent * np.maximum(n[near], n[at]))]
                    if not len(near):
                        continue
                    d, total = bits.differ(at, near), n[near] + n[at]
                    near, d = (x[(100 + percent) * d <= (100 - percent) * total] for x in (near, d / total))
                    if not len(near):
                        continue
                    if closest:
                        best = np.lexsort((doc[near], d))[:1]
                        near, d = near[best], d[best]
                    else:
                        keep = first_shared(sig[near] != sig[at]) == p[0]
                        near, d = near[keep], d[keep]
                    found.append(np.stack([np.full(len(near), doc[at]), doc[near], np.int64(1e9 * d)]))
            if found:
                a, b, d = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "d"])
        release()

    return grouped.mapInArrow(compare, "a long, b long, d long")


class Bits:
    """The parity bits of some sets, by their size; a larger set's are folded to those of a smaller."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(x) for x in rows])
        self.place = np.zeros(len(rows), np.int64)
        self.of = {}
        for size in np.unique(self.size):
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.of[size] = np.frombuffer(b"".join(rows[i] for i in at), np.uint64).reshape(len(at), -1)

    def differ(self, at: int, others: np.ndarray) -> np.ndarray:
        """How many bits of row at and each of the others differ."""
        own, out = self.of[self.size[at]][self.place[at]], np.empty(len(others), np.int64)
        for size in np.unique(self.size[others]):
            which = self.size[others] == size
            some = self.of[size][self.place[others[which]]]
            words = min(len(own), some.shape[1])
            differ = folded(some, words) ^ folded(own[None], words)
            out[which] = np.bitwise_count(differ).sum(axis=1)
        return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1) if bits.shape[1] > words else bits


def first_shared(differ: np.ndarray) -> np.ndarray:
    """The first pattern under which two signatures meet, from where their symbols differ: of the first chunk that differs
    in one symbol at most, that with this symbol left out, or the first if none differs."""
    chunks = differ.reshape(-1, CHUNKS, SYMBOLS // CHUNKS)
    errors = chunks.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    return 4 * chunk + chunks[np.arange(len(chunks)), chunk].argmax(axis=1)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of equal values in the first columns of ordered batches, each whole."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        marks = [held.column(c).to_numpy() for c in range(keys)]
        starts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if len(held) else []
        last = 0
        for start in starts:
            yield held.slice(last, start - last)
            last = start
        held = held.slice(last)
    if held is not None and len(held):
        yield held
