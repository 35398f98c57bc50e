"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted or deleted letter changes the counts of a word's letters by one in all, a replaced letter
by two (one letter less, another more). So the words near a word lie within that L1 distance of its
counts, among the words of its own length or of one letter more or less. A k-d tree per length answers
those range searches by skipping boxes that are farther; what is left is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import written

#: A run of letters, the shortest word, and the fewest occurrences that make one.
LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT = 6, 5
#: How many times a form must occur for each occurrence of the word that it stands for.
FORM_RATIO = 5
#: Words that the upper part of the trees is fitted on; every word is then put into a tree.
SAMPLE = 65_536
#: Words of a tree's leaf, which a task searches, and queries that one task takes.
LEAF_WORDS, TASK_QUERIES = 8_192, 65_536
#: Words in a box of the tree within a task, and pairs that are compared at once.
BOX_WORDS, PAIRS = 16, 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words --------------------------------------------------------------------------------

def typing_errors(doc_id: Column, run: Column, every: int = 199) -> Column:
    """``run`` without one letter where the checksum of id and run is divisible by ``every``.

    A null id leaves the run as it is.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts; a null text has none.

    Words reduce map-side, so a frequent one reaches the shuffle as one row a task.
    """
    run = F.translate("run", _UPPER, _LOWER)
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.filter(F.length("run") >= min_letters).select(typing_errors(F.col("id"), run).alias("word"))
    return (words.filter(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def letters_of(words: list[str], width: int | None = None) -> np.ndarray:
    """Code points of each word, a row each, filled up with zeros."""
    width = max(width or 0, max(map(len, words), default=0), 1)
    return np.array([w.ljust(width, "\0") for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)


def letter_counts(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each letter of the sorted ``alphabet`` is in each row; others are left out."""
    at = np.searchsorted(alphabet, letters)
    known = (letters > 0) & (alphabet[np.minimum(at, len(alphabet) - 1)] == letters)
    flat = np.arange(len(letters))[:, None] * len(alphabet) + at
    return np.bincount(flat[known], minlength=len(letters) * len(alphabet)).reshape(len(letters), -1).astype(np.int32)


# --- the upper part of the trees -------------------------------------------------------------

def widest_split(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, count from which words go right) of the evenest split of the letter that varies most."""
    for letter in np.argsort(-counts.var(axis=0), kind="stable"):
        values, sizes = np.unique(counts[:, letter], return_counts=True)
        if len(values) > 1:
            left = np.cumsum(sizes)[:-1]
            return int(letter), int(values[1:][np.argmin(np.abs(2 * left - len(counts)))])
        break
    return None


@dataclass
class TopTree:
    """The splits above the leaves, one tree per word length.

    ``splits[length]`` lists nodes as (letter, least count to the right, left, right); a negative child is the
    leaf of that number. Lengths without a tree have the single leaf 0.
    """
    alphabet: np.ndarray
    splits: dict[int, list[tuple[int, int, int, int]]]

    @classmethod
    def fit(cls, words: list[str], total: int, leaf_words: int) -> TopTree:
        """From a sample of ``total`` words: leaves hold about ``leaf_words`` words of all."""
        share = len(words) / max(1, total)
        least = max(1, leaf_words * share)
        letters = letters_of(words)
        alphabet = np.unique(letters[letters > 0]) if words else np.zeros(0, np.uint32)
        splits: dict[int, list[tuple[int, int, int, int]]] = {}
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            counts = letter_counts(letters[lengths == length], alphabet)
            nodes: list[tuple[int, int, int, int]] = []
            leaves = 0
            open_ = [(np.arange(len(counts)), -1, 0)]  # words, node above, side
            while open_:
                own, above, side = open_.pop()
                found = widest_split(counts[own]) if len(own) > least else None
                if found is None:
                    name, leaves = -1 - leaves, leaves + 1
                else:
                    name = len(nodes)
                    nodes.append((*found, 0, 0))
                    right = counts[own, found[0]] >= found[1]
                    open_ += [(own[~right], name, 0), (own[right], name, 1)]
                if above >= 0:
                    node = list(nodes[above])
                    node[2 + side] = name
                    nodes[above] = tuple(node)
            splits[int(length)] = nodes
        return cls(alphabet, splits)

    def leaves(self, length: int, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves of a length's tree that hold words within ``reach`` of each row.

        ``counts`` are those of ``self.alphabet``. Rows go down both sides of a split if the letters that they
        lack, and those they have too many, still allow it: at most ``reach`` in all.
        """
        nodes = self.splits.get(length) or []
        if not nodes:
            return np.arange(len(counts)), np.zeros(len(counts), np.int64)
        rows_out, leaves_out = [], []
        # Per row and path, the letters that are bounded so far as (letter, lacking or over): kept as a running
        # distance per letter, so that two splits on one letter count once.
        open_ = [(0, np.arange(len(counts)), {}, np.zeros(len(counts), np.int32))]
        while open_:
            name, rows, gaps, far = open_.pop()
            if name < 0:
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), -1 - name))
                continue
            letter, least, left, right = nodes[name]
            value, old = counts[rows, letter], gaps.get(letter, np.zeros(len(rows), np.int32))
            for child, gap in ((left, np.maximum(value - (least - 1), 0)), (right, np.maximum(least - value, 0))):
                new = np.maximum(old, gap)
                distance = far - old + new
                stay = distance <= reach
                if stay.any():
                    kept = {k: v[stay] for k, v in gaps.items()} | {letter: new[stay]}
                    open_.append((child, rows[stay], kept, distance[stay]))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


# --- the search within a task --------------------------------------------------------------

def box_pairs(words: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, query) of the counts that are exactly ``reach`` apart, by a k-d tree over the words."""
    open_ = [(np.arange(len(words)), np.arange(len(queries)))]
    while open_:
        own, asked = open_.pop()
        box = words[own]
        low, high = box.min(axis=0), box.max(axis=0)
        q = queries[asked]
        near = (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(axis=1) <= reach
        asked = asked[near]
        if not len(asked):
            continue
        found = widest_split(box) if len(own) > BOX_WORDS else None
        if found is not None:
            right = box[:, found[0]] >= found[1]
            open_ += [(own[~right], asked), (own[right], asked)]
            continue
        step = max(1, PAIRS // len(own))
        for start in range(0, len(asked), step):
            part = asked[start:start + step]
            apart = np.zeros((len(part), len(own)), np.int32)
            for d in np.flatnonzero((low < high) | (queries[part] != low).any(axis=0)):
                apart += np.abs(queries[part, d][:, None] - box[None, :, d])
            query, word = np.nonzero(apart == reach)
            if len(query):
                yield own[word], part[query]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of equal length differ in one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are those of ``short`` with one letter more (``long`` has one column more)."""
    width = short.shape[1]
    same_before = np.logical_and.accumulate(short == long[:, :width], axis=1).sum(axis=1)
    same_after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same_before + same_after >= width


class Best:
    """Of each word, how many near words were found and which of them is the most frequent."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.rank = np.empty(len(words), np.int64)  # smaller is a better form
        # Code-point order: Python compares strings by code points.
        self.rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        self.by_rank = np.argsort(self.rank)
        self.near = np.zeros(len(words), np.int64)
        self.form = np.full(len(words), len(words), np.int64)

    def add(self, of: np.ndarray, near: np.ndarray) -> None:
        self.near += np.bincount(of, minlength=len(self.words))
        np.minimum.at(self.form, of, self.rank[near])

    def rows(self) -> pa.Table:
        at = np.flatnonzero(self.near)
        form = self.by_rank[self.form[at]]
        return pa.table({"word": pa.array([self.words[i] for i in at], pa.string()), "near": pa.array(self.near[at], pa.int64()),
                         "form": pa.array([self.words[i] for i in form], pa.string()), "form_n": pa.array(self.n[form], pa.int64())})


def _search(table: pa.Table) -> pa.Table:
    """Near words among the words (``asks`` false) and queries of one leaf, counted per word in each direction."""
    asks = np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool)
    words = table.column("word").to_pylist()
    best = Best(words, table.column("n").to_numpy())
    lengths = np.array([len(w) for w in words])
    targets, length = np.flatnonzero(~asks), table.column("length")[0].as_py()
    if len(targets):
        letters = letters_of(words, length + 1)
        used = np.unique(letters[letters > 0])
        counts = letter_counts(letters, used)
        for gap, reach in ((0, 2), (1, 1)):
            queries = np.flatnonzero(asks & (lengths == length + gap))
            if not len(queries):
                continue
            for t, q in box_pairs(counts[targets], counts[queries], reach):
                t, q = targets[t], queries[q]
                same = (one_inserted(letters[t, :length], letters[q, :length + 1]) if gap
                        else one_replaced(letters[t, :length], letters[q, :length]))
                best.add(q[same], t[same])
                if gap:  # words of the same length ask in both directions
                    best.add(t[same], q[same])
    return best.rows()


def near_words(words: DataFrame, leaf_words: int = LEAF_WORDS, task_queries: int = TASK_QUERIES, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, form, form_n) of the words of (word, n) that have near words.

    ``form`` is the near word of largest n, of equal ones the smallest in code-point order. ``words`` must be
    distinct and are read several times, so hand in a written table.

    The splits of the upper trees are fitted on ``sample`` words taken by hash; all words are
    put into the leaves. A word asks the leaves of its own length and of one letter less that its
    letter counts can reach; with d splits above a leaf that is in the order of d squared leaves of
    2^d. Leaves with more words or queries than a task takes are dealt over several tasks, so no leaf is a task
    of its own size, and a task sends one row for each of its words, never pairs.
    """
    total = words.count()
    fitted = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(sample).select("word").collect()]
    shared = words.sparkSession.sparkContext.broadcast(TopTree.fit(fitted, total, leaf_words))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bool, np.ndarray, np.ndarray]]:
        """(batch, tree's length, whether the rows ask, rows, leaves)."""
        tree = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in texts])
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                letters = letters_of([texts[i] for i in own])
                counts = letter_counts(letters, tree.alphabet) if len(tree.alphabet) else np.zeros((len(own), 0), np.int32)
                for of, reach, asks in ((length, 0, False), (length, 2, True), (length - 1, 1, True)):
                    rows, leaves = tree.leaves(int(of), counts, reach)
                    yield batch, int(of), asks, own[rows], leaves

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, length, asks, _, leaves in places(batches):
            names, n = np.unique(leaves, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(names), length), pa.int32()), pa.array(names, pa.int64()),
                 pa.array(np.full(len(names), asks)), pa.array(n, pa.int64())], names=["length", "leaf", "asks", "n"])

    # One row a leaf, some words' worth for thousands of words.
    held = (words.select("word").mapInArrow(sizes, "length int, leaf long, asks boolean, n long")
            .groupBy("length", "leaf").agg(F.sum(F.when(~F.col("asks"), F.col("n"))).alias("words"),
                                           F.sum(F.when(F.col("asks"), F.col("n"))).alias("queries")).collect())
    parts = words.sparkSession.sparkContext.broadcast(
        {(r.length, r.leaf): (-(-r.words // (2 * leaf_words)), -(-(r.queries or 1) // task_queries)) for r in held if r.words})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, length, asks, rows, leaves in places(batches):
            split = np.array([parts.value.get((length, int(x)), (0, 0)) for x in leaves], np.int64).reshape(-1, 2)
            # A word goes to one part of the words and meets all parts of the queries, and the other way round.
            copies = split[:, 0 if asks else 1] * (split[:, 1 if asks else 0] > 0)
            at = np.repeat(np.arange(len(rows)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = rows[at] % np.maximum(split[at, 1 if asks else 0], 1)
            taken = batch.take(pa.array(rows[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), length), pa.int32()), pa.array(leaves[at], pa.int64()),
                 pa.array(other if asks else own, pa.int64()), pa.array(own if asks else other, pa.int64()),
                 pa.array(np.full(len(at), asks)), *taken.columns], names=["length", "leaf", "c", "q", "asks", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "length int, leaf long, c long, q long, asks boolean, word string, n long")
    found = dealt.groupBy("length", "leaf", "c", "q").applyInArrow(_search, "word string, near long, form string, form_n long")
    # Of equal counts the smallest form: strings compare by their bytes in UTF-8, which is code-point order.
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("neg"), "form")).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.neg")).alias("form_n"))


# --- groups ----------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of (word, form): the end of its chain of forms.

    Chains have no circle, since counts rise by a factor along them, which also keeps them short; each round
    doubles the steps that are taken and is written to the shared folder.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("of"), F.col("root").alias("next"))
        moved = steps.join(further, F.col("root") == F.col("of"), "left")
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return steps
        steps = written(moved.select("word", F.coalesce("next", "root").alias("root")), "forms")


def group_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = FORM_RATIO,
                   min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of whole texts.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times its own,
    else null; the root is where the chain of forms ends, the word itself without a form. ``n_near`` is 0
    without near words. Null and empty texts have no words, repeated rows count each time, an empty
    table gives an empty result; other columns are not looked at.
    """
    words = written(word_counts(docs, text, doc_id, min_letters, min_count), "words")
    near = written(near_words(words, **options), "near")
    named = words.join(near, "word", "left").withColumn("fits", F.col("form_n") >= F.col("n") * ratio)
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(F.col("fits"), F.col("form")).alias("form"),
                                 F.when(F.col("fits"), F.col("form_n")).alias("form_n")), "named")
    ends = roots(named.filter(F.col("form").isNotNull()).select("word", "form"))
    return (named.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
