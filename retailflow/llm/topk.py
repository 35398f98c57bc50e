"""Exact top-k by inner product: sorted lists read in step, with score bounds (no random access)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of each sorted list after which the bounds are looked at again.
DEPTHS = (0.5, 0.75, 0.9, 1.0)
#: Candidate and query vectors that meet in one task.
CANDIDATES, QUERIES = 8192, 2048
#: Candidates whose bounds are held at once.
SLICE = 1024


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    scale: float = 64.0) -> DataFrame:
    """(vec_id, vec array<double> of whole numbers); rows with a null id, a null vector or a
    null or non-finite component take no part."""
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
            .select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vec")))


class SortedLists:
    """The lists of a slice of candidates, one per component and direction, read in step.

    After reading the share d of all lists, a component is known if it lies before the reading
    position of its list. A known component counts as it is. An unknown one lies between the
    position and the list's last value, which gives an upper and a lower bound of the score; for
    a query's positive weights the list is read downwards, for its negative ones upwards.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.ranked = np.sort(x, axis=0)
        self.last_down, self.last_up = self.ranked[0], self.ranked[-1]

    def bounds(self, share: float, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper), candidates by queries."""
        n = len(self.x)
        read = min(n, max(1, int(np.ceil(share * n))))
        if read == n:
            score = self.x @ positive + self.x @ negative
            return score, score
        down, up = self.ranked[n - read], self.ranked[read - 1]
        upper = np.maximum(self.x, down) @ positive + np.minimum(self.x, up) @ negative
        lower = (np.where(self.x >= down, self.x, self.last_down) @ positive
                 + np.where(self.x <= up, self.x, self.last_up) @ negative)
        return lower, upper


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by smaller id; absent entries score -inf."""
    if scores.shape[1] > k:
        # Whole ties at the cut are kept for the sort by id.
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        width = max(k, int((scores >= floor).sum(axis=1).max()))
        if width < scores.shape[1]:
            take = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, take, 1), np.take_along_axis(ids, take, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(cand_ids: np.ndarray, cand: np.ndarray, query_ids: np.ndarray, query: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates of each query, -inf where there are fewer."""
    most = float(np.abs(cand).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, cand.shape[1])
    if most >= 2 ** 53:
        raise OverflowError("scores beyond 2^53 are not exact in doubles")
    kind = np.float32 if most < 2 ** 24 else np.float64  # either holds all sums exactly
    weights = query.T.astype(kind)
    positive, negative = np.maximum(weights, 0), np.minimum(weights, 0)
    best = np.full((len(query), k), -np.inf, dtype=kind)
    best_ids = np.full((len(query), k), np.iinfo(np.int64).max)
    for start in range(0, len(cand), SLICE):
        ids, lists = cand_ids[start:start + SLICE], SortedLists(cand[start:start + SLICE].astype(kind))
        own = ids[:, None] == query_ids[None, :]
        for share in DEPTHS:
            lower, upper = lists.bounds(share, positive, negative)
            # The k-th best score that is sure so far: of earlier slices, or of this one's lower bounds.
            floor = best[:, -1]
            if len(ids) > k and np.isneginf(floor).any():
                sure = np.where(own, -np.inf, lower)
                floor = np.maximum(floor, np.partition(sure, len(ids) - k, axis=0)[len(ids) - k])
            open_ = (upper >= floor[None, :]) & ~own
            # Outsiders can no longer qualify; few are left, so their final scores are resolved.
            if open_.mean() <= 0.02 or share == DEPTHS[-1]:
                break
        at, of = np.nonzero(open_)
        final = lower[at, of] if share == DEPTHS[-1] else np.einsum(
            "ij,ij->i", lists.x[at], weights.T[of])
        order = np.argsort(of, kind="stable")
        at, of, final = at[order], of[order], final[order]
        count = np.bincount(of, minlength=len(query))
        width = int(count.max(initial=0))
        if not width:
            continue
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        scores = np.full((len(query), k + width), -np.inf, dtype=kind)
        found = np.full((len(query), k + width), np.iinfo(np.int64).max)
        scores[:, :k], found[:, :k] = best, best_ids
        scores[of, k + place], found[of, k + place] = final, ids[at]
        best, best_ids = _best(scores, found, k)
    return best, best_ids


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        def side(flag: bool) -> tuple[np.ndarray, np.ndarray]:
            part = table.filter(pc.equal(table.column("is_query"), flag)).combine_chunks()
            if not part.num_rows:
                return np.zeros(0, np.int64), np.zeros((0, table.column("dim")[0].as_py()))
            flat = pc.list_flatten(part.column("vec")).to_numpy()
            return part.column("vec_id").to_numpy(), flat.reshape(part.num_rows, -1)

        (query_ids, query), (cand_ids, cand) = side(True), side(False)
        scores, ids = search(cand_ids, cand, query_ids, query, k)
        at, rank = np.nonzero(~np.isneginf(scores))
        return pa.table({"query_id": pa.array(query_ids[at], pa.int64()),
                         "vec_id": pa.array(ids[at, rank], pa.int64()),
                         "score": pa.array(scores[at, rank].astype(np.int64), pa.int64())})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidates_per_task: int = CANDIDATES,
          queries_per_task: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates by inner product.

    Both inputs are (vec_id, vec) of :func:`integer_vectors`. Ties go to the smaller id. A
    query's own id is no candidate of it; vectors of another length aren't either. Ids repeated
    among the queries count once, of repeated candidate rows with equal id and vector one counts.
    With fewer than ``k`` candidates all are returned, without any the query has no row.

    Rows are dealt by a hash of the id into blocks of bounded size, and a task compares one block of
    queries with one of candidates, so no task holds either table; a task returns ``k`` rows a
    query, and their merge reads ``k`` rows a candidate block.
    """
    candidates, queries = vectors.dropDuplicates(["vec_id", "vec"]), queries.dropDuplicates(["vec_id"])
    counted = candidates.agg(F.count(F.lit(1)).alias("n")).collect()[0].n, queries.count()
    c_blocks, q_blocks = (-(-n // size) or 1 for n, size in zip(counted, (candidates_per_task, queries_per_task)))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int, is_query: bool) -> DataFrame:
        return df.select("vec_id", "vec", F.size("vec").alias("dim"), F.lit(is_query).alias("is_query"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    cells = dealt(candidates, "c", c_blocks, "q", q_blocks, False).unionByName(
        dealt(queries, "q", q_blocks, "c", c_blocks, True))
    found = cells.groupBy("dim", "c", "q").applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
