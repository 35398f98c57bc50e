"""MinHash near-dedup: DartMinHash signatures of word shingles, banded joins, verified links, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.llm import bloom
from retailflow.llm.common import columns, discard, release, salted_totals, salts, tidy, unused, whole_text, written
from retailflow.llm.pieces import blocks_of

#: Words of a shingle and the similarity from which texts are linked.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 32 bands of 6 coordinates with probability 6e-5.
BANDS, ROWS = 32, 6
#: Texts, and elements of texts, of which a cell of a bucket holds about so many; a task compares two cells.
CELL_TEXTS, CELL_ELEMENTS = 256, 1 << 20
#: Cells over which a bucket's texts are spread before they are counted.
SALTS = 64
#: Elements that meet in one matrix product, and pairs of one element that are counted one by one instead.
PRODUCT, COUNTED = 8_192, 1 << 24

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text.

    A word is a run of anything but ASCII white space; its hash is that of its bytes in UTF-8.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[:len(starts)] if not len(ends) or ends[0] > 0 else ends[1:]
    power = _powers(_BASE, len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
    bounds = np.cumsum([len(r) for r in raw])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements of all texts, elements per text, 128-bit key per text as two columns).

    A text's weighted set holds its shingles with their counts. A shingle of weight w stands as w
    elements of weight one, numbered, so the Jaccard similarity of the elements is the weighted one of
    the shingles. Texts of fewer than five words are one shingle; the key tells equal word
    sequences.
    """
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = np.zeros((len(texts), 2), np.uint64)
    for side in (0, 1):
        of_word = mix(words + mix(place.astype(np.uint64) * _U(2) + _U(side + 1)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_word, dtype=np.uint64)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        keys[:, side] = mix(sums[bounds[1:]] - sums[bounds[:-1]] + counts.astype(np.uint64) * _GOLDEN)
    left = np.repeat(counts, counts) - place  # words from here to the text's end
    shingle = np.zeros(len(words), np.uint64)
    for i in range(SHINGLE_WORDS):
        part = np.zeros(len(words), np.uint64)
        part[:max(0, len(words) - i)] = words[i:]
        shingle = np.where(i < left, mix(shingle + part + _U(i + 1)), shingle)
    first = (left >= SHINGLE_WORDS) | (place == 0)
    shingle, doc = shingle[first], doc[first]
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(doc))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(shingle + copy.astype(np.uint64) * _GOLDEN), np.bincount(doc, minlength=len(texts)), keys


def signatures(elems: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash: the earliest dart of each of ``k`` coordinates, a row per text with elements.

    Darts fall on an element's unit of weight as a Poisson process in time, drawn from the element's
    hash, and each has a coordinate by its own hash. A text takes the darts of its
    elements up to a time by which it expects k ln k + 3k of them, so long texts throw few at
    each element; a text with a coordinate that no dart has hit takes twice the time. Two texts
    agree in a coordinate with a probability of their weighted Jaccard similarity.
    """
    out = np.zeros((len(counts), k), np.uint64)
    wanted = k * (np.log(k) + 3)
    todo = np.flatnonzero(counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    while len(todo):
        sizes = counts[todo]
        spread = np.repeat(np.arange(len(todo)), sizes)
        e = elems[np.repeat(bounds[todo], sizes) + np.arange(len(spread)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        until = (wanted / sizes)[spread]
        time = np.zeros(len(e))
        earliest = np.full(len(todo) * k, np.inf)
        darts, throw = [], 0
        while len(e):
            throw += 1
            h = mix(e + _U(throw * _BASE & (1 << 64) - 1))
            time = time - np.log1p(-((h >> _U(11)) * 2.0 ** -53))
            hit = time < until
            e, h, time, until, spread = e[hit], h[hit], time[hit], until[hit], spread[hit]
            dart = mix(h ^ _GOLDEN)
            cell = spread * k + (dart % _U(k)).astype(np.int64)
            darts.append((cell, time, dart))
            np.minimum.at(earliest, cell, time)
        own = np.zeros(len(todo) * k, np.uint64)
        for cell, time, dart in darts:
            won = time == earliest[cell]
            own[cell[won]] = dart[won]
        full = np.isfinite(earliest).reshape(-1, k).all(axis=1)
        out[todo[full]] = own.reshape(-1, k)[full]
        todo, wanted = todo[~full], wanted * 2
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's coordinates and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h + parts[:, :, r])
    return h


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, stop in blocks_of(texts, 1 << 20):
            yield batch.column(0).slice(start, stop - start), texts[start:stop]


def _keys(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys).tobytes()
    return pa.array([data[i:i + 16] for i in range(0, len(data), 16)], pa.binary())


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, size, bands) per row of (doc_id, text): the number of elements, and the bands of texts with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            elems, counts, keys = elements(texts)
            hashes = band_hashes(signatures(elems, counts, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [ids, _keys(keys), pa.array(counts, pa.int64()), _lists(hashes[counts > 0].ravel(), np.where(counts > 0, bands, 0))],
                names=["doc_id", "key", "size", "bands"])
    return docs.mapInArrow(tidy(run), "doc_id long, key binary, size long, bands array<long>")


def element_sets(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(key, elements), a row per word sequence whose key may be in the filter ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            elems, counts, keys = elements(texts)
            take = bloom.contains(shared.value, keys[:, 0].view(np.int64))
            flat = elems[np.repeat(take, counts)]
            yield pa.RecordBatch.from_arrays([_keys(keys[take]), _lists(flat, counts[take])], names=["key", "elements"])
    return docs.mapInArrow(tidy(run), "key binary, elements array<long>").groupBy("key").agg(F.first("elements").alias("elements"))


@F.arrow_udf(T.LongType())
def key_hash(keys: pa.Array) -> pa.Array:
    """The first half of each key as the number that :func:`element_sets` tests."""
    return pa.array(np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys.to_pylist()], np.int64))


def common_counts(elems: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, common elements) of the pairs of texts that have any: one of ``first`` with one of the others.

    Without others, pairs are those among the first, each once.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    within = bool(first.all())
    code = np.unique(elems, return_inverse=True)[1]
    on_a = first[owner]
    in_a = np.bincount(code[on_a], minlength=code.max(initial=-1) + 1)
    in_b = in_a if within else np.bincount(code[~on_a], minlength=len(in_a))
    shared = (in_a > 1) if within else (in_a > 0) & (in_b > 0)
    take = shared[code]
    code, owner, on_a = np.cumsum(shared)[code[take]] - 1, owner[take], on_a[take]
    in_a, in_b = in_a[shared], in_b[shared]
    rows = np.flatnonzero(first)
    cols = rows if within else np.flatnonzero(~first)
    place = np.zeros(len(counts), np.int64)
    place[rows], place[cols] = np.arange(len(rows)), np.arange(len(cols))
    common = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(code, kind="stable")
    code, at, on_a = code[order], place[owner[order]], on_a[order]
    code_a, at_a = (code, at) if within else (code[on_a], at[on_a])
    code_b, at_b = (code, at) if within else (code[~on_a], at[~on_a])
    if int((in_a * in_b).sum()) <= COUNTED:
        start = np.cumsum(in_b) - in_b
        each = in_b[code_a]
        other = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[code_a], each)
        flat = np.repeat(at_a, each) * len(cols) + at_b[other]
        common += np.bincount(flat, minlength=common.size).reshape(common.shape)
    else:
        for low in range(0, len(in_a), PRODUCT):
            sides = []
            for code_x, at_x, n in ((code_a, at_a, len(rows)), (code_b, at_b, len(cols))):
                part = slice(*np.searchsorted(code_x, [low, low + PRODUCT]))
                x = np.zeros((n, PRODUCT), np.float32)
                x[at_x[part], code_x[part] - low] = 1
                sides.append(x)
            common += sides[0] @ sides[1].T
    if within:
        common = np.triu(common, 1)
    a, b = np.nonzero(common)
    return rows[a], cols[b], common[a, b].astype(np.int64)


def spanning(a: np.ndarray, b: np.ndarray, roots: list[bytes]) -> list[tuple[int, int]]:
    """Those of the pairs that join two components of ``roots`` which the pairs before don't."""
    _, code = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
    ends = np.sort(np.stack([code[a], code[b]], axis=1), axis=1)
    _, once = np.unique(ends, axis=0, return_index=True)
    up = list(range(int(code.max(initial=-1)) + 1))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    out = []
    for i in once.tolist():
        x, y = top(int(ends[i, 0])), top(int(ends[i, 1]))
        if x != y:
            up[x] = y
            out.append((int(a[i]), int(b[i])))
    return out


def _compared(similarity: float):
    """Links of a task's texts: those of side 0 with those of side 1, or with each other if there is no side 1."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
        lists = table.column("elements").combine_chunks()
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        elems = lists.flatten().to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        first = side == side.min()
        if len(set(roots)) < 2:
            a = b = np.zeros(0, np.int64)
        else:
            a, b, common = common_counts(elems, counts, first)
            near = common / (counts[a] + counts[b] - common) >= similarity
            a, b = a[near], b[near]
        found = spanning(a, b, roots)
        if len(elems) >= CELL_ELEMENTS // 4:
            release()
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})
    return run


def forest(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b) either hangs on one other or has others hanging on it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of the distinct ``links`` (a, b), with one root per component.

    Alternates the large-star and small-star steps, which hang every node on the smallest one
    of its surroundings, until all nodes of a component hang on one. Each step's links are written to the
    shared folder. Minima are taken per (node, salt) first, so a node with millions of links is
    no single task.
    """
    def star(edges: DataFrame, small: bool, spread: int) -> DataFrame:
        """Hang each node's neighbours (the greater ones, or the smaller ones and itself) on their least."""
        if small:
            around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
                edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        around = around.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(spread)))
        cells = around.groupBy("u", "salt").agg(F.min("v").alias("m"))
        least = cells.groupBy(F.col("u").alias("w")).agg(F.min("m").alias("m"))
        least = least.select("w", F.least("w", "m").alias("m"))
        known = cells.select("u", "salt").join(least, F.col("u") == F.col("w")).select("u", "salt", "m")
        joined = around.join(known, ["u", "salt"])
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
                least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a != b").distinct()

    edges = links
    while not forest(edges):
        spread = salts(edges.count())
        before, edges = edges, written(star(star(edges, False, spread), True, spread), "links")
        if before is not links:
            discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shared_buckets(texts: DataFrame) -> DataFrame:
    """(bucket, key, size, lead, n) of the buckets that at least two texts share, from (key, size, bands); written.

    A bucket's lead is its most central text, that with the largest buckets on the whole, and ``n``
    its size. Buckets that surely hold one text are left out by a Bloom filter before anything shuffles.
    """
    members = texts.select(F.explode("bands").alias("bucket"), "key", "size")
    bits = bloom.build(members.select("bucket"), "bucket", texts.count() * BANDS, times=2)
    members = members.filter(bloom.test(members.sparkSession, F.col("bucket"), bits))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    sized = written(dealt.join(salted_totals(dealt, "bucket", "key", "salt", ("n", F.count(F.lit(1)), F.sum("n"))),
                               ["bucket", "salt"]).filter("n > 1"), "buckets")
    weight = sized.groupBy("key").agg(F.sum("n").alias("weight"))
    central = sized.join(weight, "key")
    best = salted_totals(central, "bucket", "key", "salt", ("lead", F.max(F.struct("weight", "key")), F.max("lead")))
    named = written(central.join(best, ["bucket", "salt"]).select("bucket", "key", "size", F.col("lead.key").alias("lead"), "n"), "buckets")
    discard(sized)
    return named


def cells_for(n: Column, size: Column) -> Column:
    """Cells for so many texts with so many elements in all."""
    return F.greatest(F.ceil(n / CELL_TEXTS), F.ceil(size / CELL_ELEMENTS))


def star_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the lead a of its largest bucket with each text b; written.

    The texts of a lead are dealt to cells, and the lead's elements go to each of them.
    """
    stars = members.filter("key != lead").groupBy("key").agg(F.max(F.struct("n", "lead", "size")).alias("most"))
    stars = stars.select("key", "most.lead", "most.size").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    totals = salted_totals(stars, "lead", "key", "salt", ("n", F.count(F.lit(1)), F.sum("n")), ("total", F.sum("size"), F.sum("total")))
    dealt = stars.join(totals, ["lead", "salt"]).select(
        "lead", "key", F.pmod(F.xxhash64("key", F.lit(1)), cells_for(F.col("n"), F.col("total"))).alias("cell"))
    leads = dealt.select("lead", "cell").distinct().select("lead", F.col("lead").alias("key"), "cell", F.lit(0).alias("side"))
    met = leads.unionByName(dealt.withColumn("side", F.lit(1))).join(sets, "key").withColumn("root", F.col("key"))
    return written(met.groupBy("lead", "cell").applyInArrow(_compared(similarity), "a binary, b binary"), "found")


def two_steps(stars: DataFrame) -> DataFrame:
    """(node, root): the lead of each linked text's lead, or the lead itself.

    Texts that are known to be connected share a root in most cases; where they don't, they are
    compared once more, which costs time but no link.
    """
    up = stars.select(F.col("b").alias("text"), F.col("a").alias("further"))
    return (stars.join(up, F.col("a") == F.col("text"), "left")
            .select(F.col("b").alias("node"), F.coalesce("further", "a").alias("root")))


def open_links(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join components, among all pairs of texts that share a bucket; written.

    Only buckets with texts of different components are looked at, of those with the same texts one. A
    bucket's texts are dealt to cells; each two cells meet in one task, which sends links that join
    components, fewer than it has texts, and never the pairs that it compares.
    """
    placed = (members.select("bucket", "key", "size").join(roots.withColumnRenamed("node", "key"), "key", "left")
              .withColumn("root", F.coalesce("root", "key")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))))
    cells = placed.groupBy("bucket", "salt").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("total"), F.bit_xor(F.xxhash64("key")).alias("mark"))
    whole = cells.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"),
                                        F.sum("total").alias("total"), F.bit_xor("mark").alias("mark")).filter("low != high")
    once = whole.groupBy("low", "high", "n", "total", "mark").agg(F.min("bucket").alias("of"))
    counted = once.select("of", cells_for(F.col("n"), F.col("total")).cast("int").alias("cells"))
    dealt = cells.select("bucket", "salt").join(counted, F.col("bucket") == F.col("of")).select("bucket", "salt", "cells")
    opened = placed.join(dealt, ["bucket", "salt"]).select(
        "bucket", "key", "root", "cells", F.pmod(F.xxhash64("key", F.lit(1)), F.col("cells")).alias("own"))
    met = (opened.join(sets, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
           .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "root",
                   (F.col("own") > F.col("other")).cast("int").alias("side"), "elements"))
    return written(met.groupBy("bucket", "i", "j").applyInArrow(_compared(similarity), "a binary, b binary"), "found")


def bucket_links(texts: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the components of all pairs that share a bucket and are similar enough.

    Each text is compared with the lead of its largest bucket first; that settles groups of thousands of
    close copies at about one comparison a text. Then all pairs of the buckets whose texts are not
    yet connected are compared, block by block within tasks, so no pair that could join two components is
    passed over and none is written.
    """
    members = shared_buckets(texts)
    keys = members.select("key").distinct()
    wanted = bloom.build(keys.select(key_hash("key").alias("h")), "h", keys.count())
    sets = written(element_sets(docs, wanted), "elements")
    stars = star_links(members, sets, similarity)
    rest = open_links(members, two_steps(stars), sets, similarity)
    discard(sets, members)
    return components(written(stars.unionAll(rest).distinct(), "links"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, class_id, class_size, kept), a row per row of ``docs``.

    Texts are linked from a weighted Jaccard similarity of ``similarity`` of their five-word shingles,
    and a class is what links connect; its id is its smallest document id, and that document is
    kept. Equal word sequences, also empty ones, are of one class and enter the search once. Null
    texts count as empty. A null id is never a class's id; in a class without an id ``class_id`` is null
    and all rows are kept. Of repeated rows with the id that stays each is kept. ``key`` tells word sequences apart.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    marks = written(signed(plain, bands, rows), "signed")
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts(marks.count()))))
    cells = salted.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"),
                                              F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = written(cells.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"),
                                             F.first("size").alias("size"), F.first("bands").alias("bands")), "texts")
    roots = bucket_links(texts.select("key", "size", "bands"), plain, similarity)
    grouped = (texts.select("key", "n", "least").join(roots.withColumnRenamed("node", "key"), "key", "left")
               .withColumn("root", F.coalesce("root", "key")))
    sizes = grouped.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = grouped.join(sizes, F.col("root") == F.col("of")).select("key", "class_id", "class_size")
    per_cell = salted.groupBy("key", "salt").agg(F.lit(1)).select("key", "salt").join(named, "key")
    return (salted.join(per_cell, ["key", "salt"])
            .select("doc_id", "key", "class_id", "class_size",
                    (F.col("class_id").isNull() | F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))).alias("kept")))


@F.arrow_udf(T.BinaryType())
def word_key(texts: pa.Array) -> pa.Array:
    """The key of each text's word sequence."""
    values = texts.to_pylist()
    parts = [_keys(elements(values[start:stop])[2]) for start, stop in blocks_of(values, 1 << 20)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class of :func:`classes`, all columns as they are.

    Only rows whose id may be among the dropped ones, by a Bloom filter, go to the join that
    takes them out; the rest pass straight through.
    """
    own_id, own_key, of, maybe = unused(docs, "id", "key", "of", "maybe")
    dropped = written(classes(docs, text, doc_id, **options).filter(~F.col("kept"))
                      .select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)), "dropped")
    bits = bloom.build(dropped.select(F.xxhash64(own_id).alias("h")), "h", dropped.count())
    tested = docs.withColumn(maybe, bloom.test(docs.sparkSession, F.xxhash64(F.col(doc_id).cast("long")), bits))
    asked = tested.filter(maybe).withColumn(of, word_key(whole_text(text)))
    stay = asked.join(dropped, F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)) & (F.col(of) == F.col(own_key)), "left_anti")
    return tested.filter(~F.col(maybe)).select(*columns(docs)).unionByName(stay.select(*columns(docs)))
