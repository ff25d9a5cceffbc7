"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are integer weights by term (component). A block of candidates is turned into postings; each
term of a block of queries scatters its weighted postings into dense score arrays; a partition selection
keeps k scores for each query, and what the tasks keep is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TOP = 5
EVERY = 50
#: Queries in a pass over the candidates, about: so many are sent to every worker at once.
QUERIES = 4096
#: Score arrays are this many queries by this many candidates.
ROWS, BLOCK = 64, 4096
SCALE = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector): floor(256 x) of each component as bigint; rows with a null id, vector or component, or one that isn't finite, are left out."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & finite).select("id", F.transform(x, lambda v: F.floor(v * SCALE)).alias("vector"))


def _matrix(vectors: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows padded with zeros to the longest, or to width."""
    values, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    return out


def _kind(queries: np.ndarray, block: np.ndarray) -> type:
    """The narrowest numbers that hold every score exactly: 32 or 64 bits, or Python's own integers."""
    width = min(queries.shape[1], block.shape[1])
    bound = sum(int(np.abs(queries[:, d].astype(object)).max(initial=0)) * int(np.abs(block[:, d].astype(object)).max(initial=0)) for d in range(width))
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**62 // BLOCK else object


def accumulate(queries: np.ndarray, block: np.ndarray, kind: type) -> np.ndarray:
    """Scores of all queries and candidates of a block, one term after another."""
    scores = np.zeros((len(queries), len(block)), kind)
    for d in range(min(queries.shape[1], block.shape[1])):
        at, rows = np.flatnonzero(block[:, d]), np.flatnonzero(queries[:, d])
        if not len(at) or not len(rows):
            continue
        weighted = np.multiply.outer(queries[rows, d].astype(kind), block[at, d].astype(kind))
        if len(at) == len(block) and len(rows) == len(queries):
            scores += weighted
        else:
            scores[np.ix_(rows, at)] += weighted
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: the ids and scores of its top candidates, ties to the smaller id (ids ascend)."""
    if scores.dtype == object:
        for i, row in enumerate(scores):
            order = [j for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j])) if ids[j] != own[i]][:top]
            limit = 2**63 - 1
            yield i, ids[order], np.array([max(-limit - 1, min(limit, row[j])) for j in order], np.int64)
        return
    n = len(ids)
    ranked = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
    lowest = np.iinfo(np.int64).min
    first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for i in np.flatnonzero(last > first):
        ranked[i, first[i] : last[i]] = lowest
    if n > top:
        ranked = np.partition(ranked, n - top, axis=1)[:, n - top :]
    for i, row in enumerate(ranked):
        row = row[row != lowest]
        score = row // n
        yield i, ids[n - 1 - (row - score * n)], score


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        kept_ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(query_ids)
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * len(query_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, block = part.column(0).to_numpy(), _matrix(part.column(1))
                order = np.argsort(ids, kind="stable")
                ids, block = ids[order], block[order]
                kind = _kind(queries, block)
                for q in range(0, len(query_ids), ROWS):
                    scores = accumulate(queries[q : q + ROWS], block, kind)
                    for i, found, score in _best(scores, ids, query_ids[q : q + ROWS], top):
                        all_ids, all_scores = np.concatenate((kept_ids[q + i], found)), np.concatenate((kept[q + i], score))
                        best = np.lexsort((all_ids, ~all_scores))[:top]
                        kept_ids[q + i], kept[q + i] = all_ids[best], all_scores[best]
        sizes = [len(x) for x in kept]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate(kept_ids)), pa.array(np.concatenate(kept))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, the top other rows by integer inner product.

    is_query is a condition on id_col. Every usable row but those of the query's own id is a candidate.
    Vectors of different lengths are compared over the components that both have; a score beyond bigint is
    held at its limit. Of rows that share a query's id, the smallest vector asks; other repeats are
    candidates of their own. An empty table gives no rows. Queries go out in blocks of a bounded number,
    one pass over the candidates for each; candidates are never shuffled and only top scores are.
    """
    asked = cut(usable(vectors.filter(is_query), id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector")))
    parts = -(-asked.count() // block)
    rows = usable(vectors, id_col, vector_col)
    found = None
    for k in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).toArrow().sort_by("id").combine_chunks()
        if not mine.num_rows:
            continue
        queries = (mine.column(0).to_numpy(), _matrix(mine.column(1).combine_chunks() if isinstance(mine.column(1), pa.ChunkedArray) else mine.column(1)))
        made = rows.mapInArrow(_search(vectors.sparkSession.sparkContext.broadcast(queries), top), "query_id long, vec_id long, score long")
        made = made if parts == 1 else cut(made)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
