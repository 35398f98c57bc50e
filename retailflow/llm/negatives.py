"""Hard-negative mining by an inverted multi-index: cells of two half-space codebooks, visited by a heap.

A vector's halves are coded on their own, and a cell holds the vectors with one pair of codes. For an
anchor, a half's score is at most that of its centre plus the anchor's half norm times the code's radius, so the sum
over both halves bounds every score of a cell. The heap hands out cells by falling bound; a search ends
when no cell that is left can change what it has found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.llm.common import written

#: Centres of each half space, and the vectors that they are fitted on (all are indexed).
CENTRES, SAMPLE, ROUNDS = 16, 4_096, 12
#: Vectors and anchors that meet in one task.
CANDIDATES, ANCHORS = 8_192, 1_024
#: Vectors that are scored at once while the heap hands out cells.
BATCH = 256
#: Positives of an anchor, negatives of a positive, and the least share of the positive's score in per cent.
POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80


def integer_rows(rows: DataFrame, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
                 scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vec array<double> of whole numbers), a row per id.

    Rows with a null id, label or vector or a null or non-finite component take no part. Equal rows count
    once; of differing rows of one id the one with the smallest vector, then label, counts.
    """
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    label = F.col("label") if label is None else label
    named = (rows.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
             .select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vec"))
             .filter(F.col("label").isNotNull()))
    return named.groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("r")).select("vec_id", "r.label", "r.vec")


# --- codebooks -------------------------------------------------------------------------------

def centres_of(x: np.ndarray, centres: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly taken first centres; the same rows give the same centres."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(centres, len(c))).astype(int)]
    for _ in range(rounds):
        code = nearest(x, c)
        sizes = np.bincount(code, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, code, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1)


Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE, centres: int = CENTRES) -> Codebooks:
    """Two codebooks for each vector length among ``sample`` vectors taken by a hash of the id."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    by_length: dict[int, list] = {}
    for r in taken:
        by_length.setdefault(len(r.vec), []).append(r.vec)
    books = {}
    for dim, vectors in by_length.items():
        x = np.array(vectors, float).reshape(len(vectors), dim)
        books[dim] = centres_of(x[:, :dim // 2], centres), centres_of(x[:, dim // 2:], centres)
    return books


# --- the index of a task's vectors -------------------------------------------------------------

class MultiIndex:
    """The vectors of a block by cell, with the radius of each code."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray] | None):
        half = x.shape[1] // 2
        self.half = half
        self.books = books or (np.zeros((1, half)), np.zeros((1, x.shape[1] - half)))
        halves = x[:, :half], x[:, half:]
        codes = [nearest(h, c) for h, c in zip(halves, self.books)]
        self.radii = []
        for h, c, code in zip(halves, self.books, codes):
            far = np.zeros(len(c))
            np.maximum.at(far, code, np.sqrt(((h - c[code]) ** 2).sum(axis=1)))
            self.radii.append(far)
        cell = codes[0] * len(self.books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        bounds = np.searchsorted(cell[order], np.arange(len(self.books[0]) * len(self.books[1]) + 1))
        self.start, self.stop = bounds[:-1].tolist(), bounds[1:].tolist()

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, start, stop) of the cells by falling upper bound: the multi-sequence heap."""
        upper, lower, order = [], [], []
        for part, c, far in zip((q[:self.half], q[self.half:]), self.books, self.radii):
            middle, reach = c @ part, np.sqrt(part @ part) * far
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            rank = np.argsort(-(middle + reach + slack), kind="stable")
            upper.append((middle + reach + slack)[rank].tolist())
            lower.append((middle - reach - slack)[rank].tolist())
            order.append(rank.tolist())
        (up1, up2), (low1, low2), (of1, of2), width = upper, lower, order, len(order[1])
        heap = [(-(up1[0] + up2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # A row's next cell waits behind its own; each row is opened by the first cell of the row before.
            if j + 1 < len(up2):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up1):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            cell = of1[i] * width + of2[j]
            if self.start[cell] < self.stop[cell]:
                yield -bound, low1[i] + low2[j], self.start[cell], self.stop[cell]

    def search(self, q: np.ndarray, wanted, lows: np.ndarray, highs: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the ``k`` best wanted vectors in each window of scores, by score and then id.

        ``wanted`` tells which rows (a slice or their numbers) take part. A window is certified once its k-th
        score, or its low end while it has fewer, is above the bound of the next cell.
        """
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        need, top = lows.astype(float), float(highs.max(initial=-np.inf))
        held: list[np.ndarray] = []
        size = 0

        def score() -> None:
            nonlocal ids, scores, held, size, need
            rows = np.concatenate(held)
            rows = rows[wanted(rows)]
            values = self.x[rows] @ q
            fits = (values >= need.min()) & (values <= top)
            ids, scores = np.concatenate([ids, self.ids[rows[fits]]]), np.concatenate([scores, values[fits]])
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            first = np.searchsorted(-scores, -highs, side="left")
            last = first + k - 1
            kth = np.where(last < len(scores), scores[np.minimum(last, len(scores) - 1)] if len(scores) else -np.inf, -np.inf)
            need = np.maximum(lows, kth)
            held, size = [], 0

        for bound, least, start, stop in self.cells(q):
            if bound < need.min():
                break
            if least > top:
                continue  # all of its scores are above every window
            held.append(np.arange(start, stop))
            size += stop - start
            if size >= BATCH:
                score()
        if held:
            score()
        out = []
        for low, high in zip(lows, highs):
            first = int(np.searchsorted(-scores, -high, side="left"))
            own = slice(first, min(first + k, int(np.searchsorted(-scores, -low, side="right"))))
            out.append((ids[own], scores[own]))
        return out


def _sides(table: pa.Table, books: Codebooks) -> tuple[pa.Table, np.ndarray, MultiIndex | None]:
    """(anchors, their vectors, index of the candidates) of one task."""
    def vectors(part: pa.Table) -> np.ndarray:
        return pc.list_flatten(part.column("vec")).to_numpy().reshape(part.num_rows, dim)

    dim = table.column("dim")[0].as_py()
    anchors = table.filter(table.column("is_anchor")).combine_chunks()
    others = table.filter(pc.invert(table.column("is_anchor"))).combine_chunks()
    q, x = vectors(anchors), vectors(others)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, dim) >= 2 ** 53:
        raise OverflowError("scores beyond 2^53 are not exact in doubles")
    index = MultiIndex(others.column("vec_id").to_numpy(), others.column("label").to_numpy(), x, books.get(dim)) if len(x) else None
    return anchors, q, index


def _positives(books: Codebooks, k: int):
    everything = np.array([-np.inf]), np.array([np.inf])

    def run(table: pa.Table) -> pa.Table:
        anchors, q, index = _sides(table, books)
        of, ids, scores = [], [], []
        for own, label, vector in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), q):
            if index is None:
                break
            (found, values), = index.search(
                vector, lambda rows: (index.labels[rows] == label) & (index.ids[rows] != own), *everything, k)
            of += [own] * len(found)
            ids.append(found)
            scores.append(values)
        return pa.table({"anchor_id": pa.array(of, pa.int64()), "positive_id": pa.array(np.concatenate([np.zeros(0), *ids]).astype(np.int64)),
                         "positive_score": pa.array(np.concatenate([np.zeros(0), *scores]).astype(np.int64))})
    return run


def _negatives(books: Codebooks, k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, q, index = _sides(table, books)
        out: dict[str, list] = {c: [] for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}
        for own, label, positives, vector in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "positives")), q):
            high = np.array([p["positive_score"] for p in positives], float)
            if index is None or not len(high):
                continue
            low = np.ceil(high * percent / 100)  # scores are whole numbers
            low += 100 * low < percent * high
            windows = index.search(vector, lambda rows: index.labels[rows] != label, low, high, k)
            for p, (ids, scores) in zip(positives, windows):
                out["anchor_id"] += [own] * len(ids)
                out["positive_id"] += [p["positive_id"]] * len(ids)
                out["positive_score"] += [p["positive_score"]] * len(ids)
                out["negative_id"] += ids.tolist()
                out["negative_score"] += scores.astype(np.int64).tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return run


def _met(rows: DataFrame, anchors: DataFrame, candidates_per_task: int, anchors_per_task: int):
    """Candidates and anchors dealt into the cells in which a block of each meets, grouped."""
    sizes = rows.count(), anchors.count()
    blocks = [-(-n // size) or 1 for n, size in zip(sizes, (candidates_per_task, anchors_per_task))]

    def dealt(df: DataFrame, is_anchor: bool) -> DataFrame:
        own, other, i = ("a", "c", 1) if is_anchor else ("c", "a", 0)
        return df.select("vec_id", "label", "vec", "positives", F.size("vec").alias("dim"), F.lit(is_anchor).alias("is_anchor"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(blocks[i])).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - i] - 1))).alias(other))

    kind = "array<struct<positive_id:bigint,positive_score:bigint>>"
    empty = F.lit(None).cast(kind)
    anchors = anchors if "positives" in anchors.columns else anchors.withColumn("positives", empty)
    return dealt(rows.withColumn("positives", empty), False).unionByName(dealt(anchors, True)).groupBy("dim", "c", "a")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least_percent: int = LEAST_PERCENT, sample: int = SAMPLE, centres: int = CENTRES,
         candidates_per_task: int = CANDIDATES, anchors_per_task: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both inputs are (vec_id, label, vec) of :func:`integer_rows`. An anchor's positives are its ``positives``
    best other rows of the same label; for each the ``negatives`` best rows of another label whose score is
    at most the positive's and at least ``least_percent`` of it are returned, all if fewer, none if there is none.
    Scores are integer inner products, ties go to the smaller id. Rows of another vector length than the
    anchor's aren't compared with it. Anchors without a positive or with only negative scores give no
    rows; an empty table gives an empty result.

    Rows are dealt by a hash of the id into blocks of bounded size, whatever their label, and a task holds one
    block of rows and one of anchors. The positives are written before their negatives are looked for.
    """
    rows = written(rows, "rows")
    books = fit_codebooks(rows, sample, centres)
    found = (_met(rows, anchors, candidates_per_task, anchors_per_task)
             .applyInArrow(_positives(books, positives), "anchor_id long, positive_id long, positive_score long"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
              .groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives")))
    asked = written(anchors.join(chosen, anchors["vec_id"] == chosen["anchor_id"]).select("vec_id", "label", "vec", "positives"), "asked")
    found = (_met(rows, asked, candidates_per_task, anchors_per_task).applyInArrow(
        _negatives(books, negatives, least_percent),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
