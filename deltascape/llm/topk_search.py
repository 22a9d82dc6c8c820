"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, queries into bounded batches; every batch meets every block once. A
block keeps its distinct vectors, each with the smallest of its ids, k more than any id repeats, and a sorted list per dimension. A query
walks the lists from their good ends in rounds, scores what it meets for the first time, and stops when the bound of
the unseen, the sum of the last values met, cannot reach its kth result. The per-block results meet in one top k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import select_present

#: Rows of a block, queries of a batch.
BLOCK_ROWS, BATCH_QUERIES = 4096, 1024
SCALE = 1024
#: List entries that a query reads per dimension in its first round; each later round doubles the depth.
FIRST_DEPTH = 32


class Block:
    """Distinct integer vectors with their ids and their sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        self.vectors = vectors[starts]
        # k stay whichever id asks
        self.spare = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
        self.ids = [ids[a : min(b, a + k + self.spare)] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")  # ascending values, a column per dimension
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) without the query's own id, best first; and how many vectors were scored."""
        n = len(self.vectors)
        dims = np.flatnonzero(query)
        if not len(dims):
            dims = np.array([0])
        q = query[dims]
        up = q > 0
        seen = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        depth, at = min(FIRST_DEPTH, n), 0
        while at < n:
            # sorted access, from the end where the dimension adds most
            down_rows = self.lists[n - depth : n - at][:, dims[up]]
            up_rows = self.lists[at:depth][:, dims[~up]]
            seen_before = seen.copy()
            seen[down_rows.ravel()] = True
            seen[up_rows.ravel()] = True
            new = np.flatnonzero(seen & ~seen_before)
            if len(new):  # random access to the whole vector of each new one
                scores = self.vectors[new] @ query
                if len(best) == k:
                    keep = scores >= best[-1][0]
                    new, scores = new[keep], scores[keep]
                if len(new) > k + self.spare:
                    floor = np.partition(scores, len(scores) - k - self.spare)[len(scores) - k - self.spare]
                    keep = scores >= floor
                    new, scores = new[keep], scores[keep]
                found = [(int(s), int(i)) for r, s in zip(new, scores, strict=True) for i in self.ids[r] if i != own]
                best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
            at = depth
            if at < n and len(best) == k:
                edge = np.where(up, self.sorted[n - at][dims], self.sorted[at - 1][dims])
                if int(edge @ q) < best[-1][0]:  # an equal bound could still bring a smaller id
                    break
            depth = min(2 * depth, n)
        return best, int(seen.sum())


def search_pair(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(rows):
        block = Block(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64), k)
        for own, vector in zip(queries["query_id"], queries["query"], strict=True):
            best, scored = block.search(int(own), np.asarray(vector, np.int64), k)
            out += [(own, i, s, scored) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "scored"])


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the array of floor(scale * component), of vectors without null or non-finite components."""
    rows = select_present(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(fine).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by integer inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by query_every, candidates all rows but the query's own. Vectors
    (columns vec_id and embedding are read) that are null, have no id or hold null or non-finite components take no
    part; empty vectors score 0 with one another. Every row is a candidate, also those that repeat a vec_id, but for those
    of the query's own id; an id that asks with several vectors has the best of all. Vectors shorter than the longest are
    as if filled with 0. Scores are 64-bit sums: components up to 2**20 at 1024 dimensions stay within them.
    Fewer candidates than k give fewer rows; an empty table none.
    """
    rows = integer_vectors(vectors)
    widest = rows.agg(F.max(F.size("v")), F.count("*"), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    width, count, asked = max(widest[0] or 1, 1), widest[1], widest[2]
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    blocks, batches = -(-count // block_rows) or 1, -(-asked // batch_queries) or 1
    spread = F.xxhash64("vec_id", "v")
    # columns of other names: both sides of a cogroup come from one table
    queries = rows.filter(F.col("vec_id") % query_every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.pmod(spread, F.lit(batches)).cast("int").alias("q_batch"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q_block")
    )
    blocked = rows.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    found = queries.groupBy("q_block", "q_batch").cogroup(blocked.groupBy("block", "batch")).applyInPandas(
        lambda q, r: search_pair(q, r, k), "query_id long, vec_id long, score long, scored long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
