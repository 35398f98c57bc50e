"""Quality scores by the votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.llm.common import tidy, whole_text, without
from retailflow.llm.near import mix, word_hashes
from retailflow.llm.pieces import blocks_of

#: Labelled documents per label, at most, that the space is fitted on and that vote.
SAMPLE_PER_LABEL = 1024
#: Latent dimensions, voters per document.
DIMENSIONS, NEIGHBOURS = 48, 25
#: Hashed terms of each kind.
GRAM_TERMS, WORD_TERMS, SHAPE_TERMS = 1024, 512, 512
TERMS = GRAM_TERMS + WORD_TERMS + SHAPE_TERMS
#: Documents whose cosines are held at once.
BLOCK_DOCS = 512
ACCEPT = 0.7

_U = np.uint64
_CLASS = np.full(256, 31, np.uint8)  # bytes of other scripts
for _i, _c in enumerate("\n\t |!?.,;:#$%&*@+-=/<>()[]{}\"'_"):
    _CLASS[ord(_c)] = min(_i, 26)
for _first, _last, _kind in ((0x30, 0x39, 27), (0x41, 0x5A, 28), (0x61, 0x7A, 29), (0xC2, 0xC3, 30)):
    _CLASS[_first:_last + 1] = _kind


def terms(texts: list[str]) -> np.ndarray:
    """Term counts of each text: byte trigrams, trigrams of character kinds, and words told by
    how often the text has used them before.

    The last kind are pseudo-words for a word's repeats: its class of count, and whether it equals the word before
    it. All are hashed to a fixed number of columns.
    """
    out = np.zeros((len(texts), TERMS), np.float32)
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths)
    if len(data) > 2:
        same = doc[2:] == doc[:-2]
        of = doc[2:][same]
        low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint64)
        gram = mix(low[:-2] | (low[1:-1] << _U(8)) | (low[2:] << _U(16))) % _U(GRAM_TERMS)
        kind = _CLASS[data].astype(np.uint64)
        shape = mix(kind[:-2] | (kind[1:-1] << _U(5)) | (kind[2:] << _U(10)) | _U(1 << 20)) % _U(SHAPE_TERMS)
        for start, column in ((0, gram), (GRAM_TERMS + WORD_TERMS, shape)):
            out += np.bincount(of * TERMS + start + column[same].astype(np.int64),
                               minlength=out.size).reshape(out.shape).astype(np.float32)
    words, counts = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), counts)
    if len(words):
        order = np.lexsort((words, of))
        w, d = words[order], of[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        at = np.arange(len(w))
        uses = np.zeros(len(w), np.int64)
        uses[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        again = np.zeros(len(w), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        label = np.minimum(np.log2(uses + 1).astype(np.int64), 15) * 2 + again
        out += np.bincount(of * TERMS + GRAM_TERMS + label, minlength=out.size).reshape(out.shape).astype(np.float32)
        length = np.minimum(np.bincount(of, minlength=len(texts)), 1 << 30)
        out[np.arange(len(texts)), GRAM_TERMS + 32 + np.log2(np.maximum(length, 1)).astype(np.int64)] += (length > 0)
    return out


@dataclass(frozen=True)
class Space:
    """Term weights and axes of the latent space, the labelled vectors in it, and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of texts; zero for those without terms."""
        v = weighted(counts, self.weights) @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def vote(self, latent: np.ndarray, neighbours: int) -> np.ndarray:
        """The mean label of the nearest labelled vectors, weighted by the square of their cosines."""
        out = np.full(len(latent), self.prior)
        k = min(neighbours, len(self.labels))
        for start in range(0, len(latent) if k else 0, BLOCK_DOCS):
            block = latent[start:start + BLOCK_DOCS]
            cosines = block @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 2
            total = weight.sum(axis=1)
            known = total > 0
            out[start:start + BLOCK_DOCS][known] = (weight * self.labels[near]).sum(axis=1)[known] / total[known]
        return np.clip(out, 0, 1)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithmic term frequency within each kind, times the term's weight, in unit length."""
    out = np.empty_like(counts)
    for start, stop in ((0, GRAM_TERMS), (GRAM_TERMS, GRAM_TERMS + WORD_TERMS), (GRAM_TERMS + WORD_TERMS, TERMS)):
        part = counts[:, start:stop]
        total = np.maximum(part.sum(axis=1, keepdims=True), 1)
        out[:, start:stop] = np.sqrt(part / total)
    return out * weights


def fit(sample: list[tuple[str, int]], dimensions: int = DIMENSIONS) -> Space:
    """The space of a sample of (text, label)."""
    counts = np.concatenate([terms([t for t, _ in sample[a:b]]) for a, b in blocks_of([t for t, _ in sample], 2 << 20)]
                            or [np.zeros((0, TERMS), np.float32)])
    return fit_terms(counts, [y for _, y in sample], dimensions)


def fit_terms(counts: np.ndarray, known: list[int], dimensions: int = DIMENSIONS) -> Space:
    """The space of a sample's term counts and labels: the leading right singular vectors of its weighted terms."""
    labels = np.array(known, np.float64)
    seen = (counts > 0).sum(axis=0)
    weights = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
    x = weighted(counts, weights)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = vectors[:, ::-1][:, :dimensions].astype(np.float32)
    space = Space(weights, axes, np.zeros((0, axes.shape[1]), np.float32), labels, float(labels.mean()) if len(labels) else 0.5)
    return Space(weights, axes, space.latent(counts), labels, space.prior)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@F.arrow_udf(T.BinaryType())
def term_bytes(texts: pa.Array) -> pa.Array:
    """The term counts of each text as single floats; a text counts whole, whatever its length."""
    values = [t or "" for t in texts.to_pylist()]
    return pa.array([row.tobytes() for a, b in blocks_of(values, 1 << 20) for row in terms(values[a:b]).astype(np.float32)], pa.binary())


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Term counts (``terms``) and label (``quality``) of at most ``per_label`` documents of each label, by the order of a hash of the id.

    Rows held out, and labels other than 0 and 1, are left aside; of a document's repeated labels the
    smaller counts, of its repeated rows the smallest text. Terms are counted by the tasks, 8 kB a document.
    """
    known = (labels.filter(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
             .withColumn("order", F.xxhash64("labelled")))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy("order", "labelled").limit(per_label)
        picked = part if picked is None else picked.unionAll(part)
    return (docs.select(F.col("doc_id"), whole_text(text).alias("t"))
            .join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))  # 2 * per_label rows at most
            .groupBy("order", "labelled", "quality").agg(F.min("t").alias("t"))
            .select("order", "labelled", "quality", term_bytes("t").alias("terms")))


def fit_rows(rows: DataFrame) -> Space:
    """The space of :func:`labelled_rows`, fitted by one task, as that takes some 200 MB; the driver gets a row of under 1 MB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if sample is None:
            return
        sample = sample.sort_by([("order", "ascending"), ("labelled", "ascending")])
        counts = np.frombuffer(b"".join(sample["terms"].to_pylist()), np.float32).reshape(-1, TERMS)
        space = fit_terms(counts, sample["quality"].to_pylist())
        parts = {f.name: [v.tobytes() if isinstance(v := getattr(space, f.name), np.ndarray) else v] for f in fields(Space)}
        yield pa.RecordBatch.from_pydict(parts)

    found = rows.repartition(1).mapInArrow(tidy(run), "weights binary, axes binary, vectors binary, labels binary, prior double").collect()
    if not found:
        return fit_terms(np.zeros((0, TERMS), np.float32), [])
    row = found[0]
    weights, axes, vectors = (np.frombuffer(b, np.float32) for b in (row.weights, row.axes, row.vectors))
    axes = axes.reshape(TERMS, -1)
    return Space(weights, axes, vectors.reshape(-1, axes.shape[1]), np.frombuffer(row.labels, np.float64), row.prior)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", per_label: int = SAMPLE_PER_LABEL,
          neighbours: int = NEIGHBOURS, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    The text alone makes the score. Texts without terms (null and empty ones), and all texts when no label
    is known, get the share of label 1 in the sample (0.5 without one). Repeated rows and equal texts score alike.
    Input columns named like the results are replaced. The labelled vectors, at most 2 * ``per_label`` of
    48 numbers, are broadcast; each document is compared with all of them. Only texts go to the Python
    workers and only scores come back.
    """
    docs = without(docs, "held_out", "score", "predicted")
    space = docs.sparkSession.sparkContext.broadcast(fit_rows(labelled_rows(docs, labels, text, per_label)))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            values, parts = batch.to_pylist(), []
            for start, stop in blocks_of(values, 1 << 20):
                counts = terms(values[start:stop])
                latent = space.value.latent(counts)
                latent[[i for i, t in enumerate(values[start:stop]) if not t]] = 0
                parts.append(space.value.vote(latent, neighbours))
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(texts)

    # Not deterministic to the optimizer, which would else call it once more for a filter on the result.
    return (docs.withColumn("score", scored.asNondeterministic()(whole_text(text))).withColumn("held_out", held_out())
            .withColumn("predicted", (F.col("score") >= accept).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those predicted to be bad."""
    return without(score(docs, labels, **options).filter("predicted = 1"), "held_out", "score", "predicted")
