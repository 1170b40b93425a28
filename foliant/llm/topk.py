"""Exact top-k by inner product: the threshold algorithm over sorted lists of each dimension.

Rows are taken in blocks of bounded size. A block has, for each dimension, its rows in order of that component. For a
query the lists are read from their better ends in step; every row met is scored in full; the sum over dimensions of
the query's component times the component where its list stands bounds all rows not met. Reading stops when that bound
is under the k-th score (at an equal bound a row with a smaller id could still follow).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, open_store, scratch_path

#: Rows in a block of vectors, and in a block of queries that is compared with it.
BLOCK_ROWS, QUERY_ROWS = 65_536, 1024
#: Scores are longs; larger ones are kept at the ends of their range.
LONG_MAX = (1 << 63) - 1


#: Doubles as integers of any size.
_whole = np.frompyfunc(int, 1, 1)


class SortedLists:
    """A block of integer vectors, and its rows in order of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.copy()
        self.largest = int(max(abs(self.rows.max(initial=0)), abs(self.rows.min(initial=0))))

    def best(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with own_id; ties go to smaller ids."""
        n, d = self.rows.shape
        exact = self.largest * int(np.abs(query).max(initial=0)) * d < 1 << 53
        rows, query = (self.rows, query) if exact else (_whole(self.rows), _whole(query))
        met = self.ids == own_id
        top, scores = np.empty(0, np.int64), np.empty(0, rows.dtype)
        up, down, used = np.flatnonzero(query < 0), np.flatnonzero(query > 0), np.flatnonzero(query != 0)
        at, step = 0, max(32, 2 * k)
        while at < n:
            end = min(n, at + step) if len(used) else n
            near = np.concatenate([self.order[up, at:end].ravel(), self.order[down, n - end : n - at].ravel()]) if len(used) else np.arange(n)
            new = np.zeros(n, bool)
            new[near] = True
            new &= ~met
            found = np.flatnonzero(new)
            met |= new
            top, scores = np.concatenate([top, found]), np.concatenate([scores, rows[found] @ query])
            keep = np.lexsort((top, -scores))[:k]  # rows are in order of their ids
            top, scores = top[keep], scores[keep]
            bound = sum(query[j] * rows[self.order[j, end - 1], j] for j in up) + sum(query[j] * rows[self.order[j, n - end], j] for j in down)
            if len(top) == k and bound < scores[-1]:
                break
            at, step = end, step * 2
        return self.ids[top], scores


def to_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and v: floor(scale * x) of each component as double. Rows without an id, without a vector, or with a null or
    non-finite component are left out."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    def floor(x):
        return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)  # larger doubles are whole

    whole = F.transform(v, lambda x: floor(x * F.lit(float(scale))))
    return only(vectors, id_col, vec_col).filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def threshold_topk(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row for which the column expression is_query holds, its k highest
    integer inner products among all rows with another id, ties to the smaller id; fewer if there are fewer.

    Only vectors of a query's length are compared with it. Rows that repeat an id count as rows of their own (a query's
    repeats give its result once, from the first by value). The queries are written to the shared folder, where every
    task reads them in blocks; no vector is shuffled, only the best k of each block and query.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = to_integers(vectors, id_col, vec_col, scale)
    path = scratch_path(spark, "queries")
    rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).write.parquet(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for length, ids, values in by_length(block):
                lists = SortedLists(ids, values)
                store, top = open_store(path)
                for queries in ds.dataset(top, filesystem=store, format="parquet").to_batches(batch_size=QUERY_ROWS):
                    for _, query_ids, query_values in by_length(queries, length):
                        parts = [lists.best(q, own, k) for own, q in zip(query_ids, query_values)]
                        scores = [min(max(int(s), -LONG_MAX - 1), LONG_MAX) for _, some in parts for s in some]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, [len(t) for t, _ in parts])), pa.array(np.concatenate([t for t, _ in parts])), pa.array(scores, pa.int64())], ["query_id", "id", "score"])

    found = rows.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_length(block: pa.RecordBatch, only_length: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ids and the matrix of a block's vectors, for each length that occurs."""
    ids, vectors = block.column(0).to_numpy(), block.column(1)
    lengths = vectors.value_lengths().to_numpy()
    values, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
    for length in np.unique(lengths) if only_length is None else [only_length]:
        some = np.flatnonzero(lengths == length)
        if len(some):
            yield int(length), ids[some], values[(starts[some][:, None] + np.arange(length))].reshape(len(some), length)
