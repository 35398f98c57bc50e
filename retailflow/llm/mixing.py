"""Mixing sources to target weights by fixed-length blocks of their token streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.llm.common import WORD, columns, unused, whole_text, written

#: Words of a block, blocks of an output shard.
BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
#: Documents of a source whose sizes one task adds up.
RUN_DOCS = 4096
#: Sources that a mix may have; its plan is a table of one row a source.
MOST_SOURCES = 100_000
#: numpy draws hypergeometric counts below this many slots; above, :func:`hypergeometric` draws them itself.
EXACT_SLOTS = 1_000_000_000


@dataclass(frozen=True)
class Source:
    number: int
    size: int
    target: float
    blocks: int
    slots: int


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets by weight, none above ``most`` times its size; what is cut off goes to the rest by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def hypergeometric(random: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` draws without putting back are good, at any size: rejection from a table mountain hat.

    The hat is that of the ratio of uniforms method for unimodal discrete distributions.
    """
    if not good or not bad or not taken or taken == good + bad:
        return min(good, taken)
    if good + bad < EXACT_SLOTS:
        return int(random.hypergeometric(good, bad, taken))
    whole = good + bad
    low, high = max(0, taken - bad), min(good, taken)
    mean = taken * (good / whole)
    spread = math.sqrt(mean * (bad / whole) * ((whole - taken) / (whole - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (taken + 1) * (good + 1) // (whole + 2)

    def ratio(k: int) -> float:
        """Logarithm of the chance of k over that of the mode."""
        parts = ((mode, k), (good - mode, good - k), (taken - mode, taken - k), (bad - taken + mode, bad - taken + k))
        return sum(math.lgamma(a + 1) - math.lgamma(b + 1) for a, b in parts)

    while True:
        u, v = 1 - random.random(), random.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= ratio(k):
            return k


def split_counts(counts: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each source's slots fall among the first ``left`` of them all, by chance."""
    total = int(counts.sum())
    if left <= 0 or left >= total:
        return counts if left >= total else np.zeros_like(counts)
    random = np.random.Generator(np.random.Philox(seed=np.random.SeedSequence(seed)))
    if total < EXACT_SLOTS:
        return random.multivariate_hypergeometric(counts, left, method="marginals").astype(np.int64)
    out = np.zeros_like(counts)
    for i, own in enumerate(counts.tolist()):
        total -= own
        out[i] = drawn = hypergeometric(random, own, total, left)
        left -= drawn
    return out


def shard_counts(slots: np.ndarray, shard: int, shards: int, shard_blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of each source in an output shard.

    The counts of all shards are multinomial draws given the sources' totals. They come from
    halving the range of shards down to this one, each halving seeded by its range, so every
    task finds the counts of its shard, and the slots used before it, alone.
    """
    low, high, counts = 0, shards, slots.astype(np.int64)
    first = np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(counts, (middle - low) * shard_blocks, (seed, low, high))
        if shard < middle:
            high, counts = middle, left
        else:
            low, counts, first = middle, counts - left, first + left
    return first, counts


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..size-1, chosen by ``key``, takes each index.

    A four-round Feistel network over the next even power of two; images beyond the range go
    through it again until they fall inside.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for round_ in range(4):
            left, right = right, left ^ (_mix64(right ^ _mix64(key[todo] + np.uint64(round_ + 1))) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the whole text; null has none."""
    return docs.withColumn("size", F.size(F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0))).cast("long"))


def placed(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` (with ``source`` and ``size``) with ``start``, the first word's place in the source's stream.

    A source's documents are dealt by a hash of the id into runs, whose totals are added up
    first, so that a source with a third of all rows is no task of its own.
    """
    runs = max(1, -(-rows // RUN_DOCS))
    dealt = docs.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    totals = dealt.groupBy("source", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("__source"), F.col("run").alias("__run"),
                           F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "run").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (inside.join(totals, F.col("source").eqNullSafe(F.col("__source")) & (F.col("run") == F.col("__run")))
            .withColumn("start", F.col("base") + F.col("inner")).drop("__source", "__run", "base", "inner", "run"))


def plan_sources(rows: DataFrame, stream: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0),
                 ratio: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, number, source_size, target, blocks, slots), a row per source.

    Sources by code point, null last, take the weights in turn. The targets share ``ratio`` times
    all words, none above ``most`` times its source. A source has as many slots as its target has
    blocks of the source's mean weight. ``rows`` are all rows, ``stream`` holds repeated ones once.
    The plan is a small table: more than ``MOST_SOURCES`` sources raise.
    """
    found = (rows.groupBy("source").agg(F.sum("size").alias("words"))
             .join(stream.groupBy(F.col("source").alias("__source")).agg(F.sum("size").alias("streamed")),
                   F.col("source").eqNullSafe(F.col("__source")))
             .select("source", "words", "streamed").limit(MOST_SOURCES + 1).collect())
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    targets = share_out([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))],
                        ratio * sum(r.words for r in found), most)
    table = []
    for number, (r, target) in enumerate(zip(found, targets)):
        blocks = -(-r.streamed // block_words)
        slots = min(int(most * blocks), round(target * blocks / r.words)) if r.words else 0
        table.append((r.source, number, r.words, target, blocks, slots))
    schema = pa.schema([("source", pa.string()), ("number", pa.int32()), ("source_size", pa.int64()),
                        ("target", pa.float64()), ("blocks", pa.int64()), ("slots", pa.int64())])
    if not table:
        return rows.sparkSession.createDataFrame(
            [], "source string, number int, source_size long, target double, blocks long, slots long")
    # An Arrow table passes through no Python worker. Rows would: those of RDDs are a set of their own in each executor, kept
    # beside the workers of the SQL steps.
    return rows.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*table), schema)], schema=schema))


def draw_slots(plan: DataFrame, seed: int = 7, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(number, block, shard, epoch), a row per slot of the mix.

    A source's slot i, counted over all shards, takes block p(i mod blocks) of the source, p being
    the permutation of pass i div blocks; a block is taken once a pass.
    """
    sources = [Source(r.number, r.source_size, r.target, r.blocks, r.slots)
               for r in plan.orderBy("number").collect() if r.slots]
    total = sum(s.slots for s in sources)
    shards = -(-total // shard_blocks)
    slots = np.array([s.slots for s in sources], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_counts(slots, shard, shards, shard_blocks, seed)
                for source, start, count in zip(sources, first, counts):
                    if not count:
                        continue
                    slot = np.arange(start, start + count)
                    epoch, place = slot // source.blocks, slot % source.blocks
                    key = _mix64((np.uint64(seed) << np.uint64(40)) ^ (np.full(len(slot), source.number, np.uint64)
                                 << np.uint64(16)) ^ epoch.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), source.number), pa.int32()),
                         pa.array(permuted(place, source.blocks, key), pa.int64()),
                         pa.array(np.full(len(slot), shard), pa.int64()), pa.array(epoch, pa.int64())],
                        names=["number", "block", "shard", "epoch"])

    spark = plan.sparkSession
    return spark.range(0, shards).repartition(max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(
        run, "number int, block long, shard long, epoch long")


def _drawn(docs: DataFrame, text: str, doc_id: str, source: str, block_words: int, seed: int,
           **plan_options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, row, size), the sources' plan, and the pieces taken.

    A piece (doc_id, row, number, size, first, words, times) is the part of a document in one block
    that the mix takes ``times`` times. The narrow rows are written once, as all of this reads them.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                         F.xxhash64(whole_text(text)).alias("row"), whole_text(text).alias("__text"))
    narrow = written(sized(narrow, "__text").drop("__text"), "mix")
    stream = narrow.dropDuplicates(["doc_id", "source", "row"])
    plan = plan_sources(narrow, stream, block_words=block_words, **plan_options)
    numbers = F.broadcast(plan.select(F.col("source").alias("__source"), "number"))  # MOST_SOURCES at most
    starts = placed(stream.filter("size > 0"), narrow.count()).join(
        numbers, F.col("source").eqNullSafe(F.col("__source")))
    long = F.lit(block_words)
    spread = starts.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / long), F.floor((F.col("start") + F.col("size") - 1) / long))))
    begin = F.greatest(F.col("start"), F.col("block") * long)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * long)
    pieces = spread.select("doc_id", "row", "size", "number", "block", (begin - F.col("start")).alias("first"),
                           (end - begin).alias("words"))
    times = draw_slots(plan, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    # Both sides grow with the documents, so neither is to be broadcast.
    return narrow, plan, pieces.join(times.hint("merge"), ["number", "block"])


def mix_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
               block_words: int = BLOCK_WORDS, seed: int = 7, **plan_options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per input row.

    ``taken`` counts the document's words in the blocks that the mix takes, repeats counted. Null texts
    and texts without words have size and taken 0. Repeated rows, equal in id, source and text,
    stand in the stream once and share its draws, so each has the same count. The draw depends on
    ids, texts and seed alone, so reruns agree.
    """
    narrow, plan, pieces = _drawn(docs, text, doc_id, source, block_words, seed, **plan_options)
    taken = pieces.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("number").alias("__number")).agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    of_source = F.broadcast(plan.select(F.col("source").alias("__source"), "number", "source_size", "target"))
    return (narrow.join(of_source, F.col("source").eqNullSafe(F.col("__source")))
            .join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
                  & (F.col("number") == F.col("__number")), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


def mix_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                  block_words: int = BLOCK_WORDS, seed: int = 7, **plan_options) -> DataFrame:
    """The mix as documents: a row per pass and document with the words taken in that pass.

    Columns are those of ``docs``; ``n_chars``, where there is one, is set anew. A document taken
    whole keeps its text unchanged, of others the words of the blocks taken stand in their order,
    each with the white space before it. Documents of which nothing is taken, empty ones among
    them, have no row. Repeated rows share their draws as in :func:`mix_counts`.
    """
    _, plan, pieces = _drawn(docs, text, doc_id, source, block_words, seed, **plan_options)
    (own_id, own_hash, own_of, own_size, own_spans, own_times, own_row, own_source, own_number, own_pass, own_words, own_split) = unused(
        docs, "id", "hash", "of", "size", "spans", "times", "row", "source", "number", "pass", "words", "split")
    span = F.struct("first", (F.col("first") + F.col("words")).alias("end"), "times")
    taken = pieces.groupBy(F.col("doc_id").alias(own_id), F.col("row").alias(own_hash), F.col("number").alias(own_of),
                           F.col("size").alias(own_size)).agg(
        F.array_sort(F.collect_list(span)).alias(own_spans), F.max("times").alias(own_times))
    numbers = F.broadcast(plan.select(F.col("source").alias(own_source), F.col("number").alias(own_number)))
    joined = (docs.withColumn(own_row, F.xxhash64(whole_text(text)))
              .join(numbers, F.col(source).eqNullSafe(F.col(own_source)))
              .join(taken, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(own_row) == F.col(own_hash))
                    & (F.col(own_number) == F.col(own_of)))
              .withColumn(own_pass, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own_times))))
              .withColumn(own_spans, F.filter(own_spans, lambda s: s["times"] >= F.col(own_pass)))
              .withColumn(own_words, F.aggregate(own_spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    picked = F.array_join(F.flatten(F.transform(F.col(own_spans), lambda s: F.slice(
        F.col(own_split), s["first"].cast("int") + 1, (s["end"] - s["first"]).cast("int")))), "")
    whole = F.col(own_words) == F.col(own_size)
    out = (joined.withColumn(own_split, F.when(~whole, words))
           .withColumn(text, F.when(whole, F.col(text)).otherwise(picked)))
    for name in (c for c in docs.columns if c.lower() == "n_chars"):
        out = out.withColumn(name, F.length(text).cast(docs.schema[name].dataType))
    return out.select(*columns(docs))
