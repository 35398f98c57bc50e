"""Personal data: span generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from heapq import heappush, heapreplace
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.llm.common import columns, numbered, tidy, unused, whole_text, without, written
from retailflow.llm.pieces import blocks_of

KINDS = ("email", "ip", "card", "phone")
#: Documents the trees are trained on at most, and candidates taken from them.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 4000, 8000
#: Precision that a kind's threshold must reach on all candidates of the held-back quarter of the texts, and
#: the number of accepted candidates there that must show it.
PRECISION, SUPPORT = 0.99, 10
#: Texts are held back by their hash, one of so many; scores are counted in so many steps.
HELD, STEPS = 4, 4096
#: What texts show that may hold a kind; texts that train are taken for each of these.
SIGNS = (r"@|\b[Aa][Tt]\b", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:[0-9][\x20().\-/_·]{0,2}){13}", r"\+[0-9]", "[0-9]{3}")
TREES, DEPTH = 20, 3
CONTEXT = 24
#: Candidates of a text whose features are held at once.
JUDGED = 4096

Span = tuple[int, int]


# --- base rules ----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def emails(text: str) -> list[Span]:
    """Found from the at signs, so that a long run of letters is looked at once."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            spans.append((start, end))
        at = text.find("@", max(at + 1, end))
    return spans


def addresses(text: str) -> list[Span]:
    """Dotted runs of numbers in fours, as a leftmost match takes them."""
    spans = []
    for run in _DOTTED.finditer(text):
        numbers = [m.span() for m in _NUMBER.finditer(text, run.start(), run.end())]
        for i in range(0, len(numbers) - 3, 4):
            if all(b - a < 4 or not text[a:b - 3].strip("0") for a, b in numbers[i:i + 4]) and all(
                    int(text[max(a, b - 3):b]) <= 255 for a, b in numbers[i:i + 4]):
                spans.append((numbers[i][0], numbers[i + 3][1]))
    return spans


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text)
            if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the fixed rules, by kind."""
    digit = _DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [],
            "ip": addresses(text) if digit and "." in text else [],
            "card": cards(text) if digit else [],
            "phone": phones(text) if digit and "+" in text else []}


# --- generators --------------------------------------------------------------------------------

#: What stands for the at sign, and what follows it; the name before it is read backwards from there.
_LOOSE_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}|\bat\b", re.I)
_LOOSE_DOMAIN = re.compile(
    r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?[A-Za-z0-9-]{1,63}){1,6}", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|,)\s?[0-9]{1,3}){3}(?![0-9])")
#: What may stand between two digit groups of one number.
_JOINT = re.compile(r"[\x20().\-/_·]{1,2}")
#: Digits of a phone number and of a card.
PHONE_DIGITS, CARD_DIGITS = range(7, 16), range(13, 20)


def luhn_windows(digits: str) -> Iterator[Span]:
    """Parts of an unbroken run with as many digits as a card that pass Luhn, but not the whole run."""
    n = len(digits)
    if n <= CARD_DIGITS[0]:
        return
    # For either parity of the last digit, sums up to each place with every second digit doubled.
    sums = [[0], [0]]
    for i, d in enumerate(digits):
        v = ord(d) - 48
        for parity in (0, 1):
            sums[parity].append(sums[parity][-1] + (v if i % 2 == parity else v * 2 - 9 if v > 4 else v * 2))
    for start in range(n - CARD_DIGITS[0] + 1):
        for end in range(start + CARD_DIGITS[0], min(start + CARD_DIGITS[-1], n) + 1):
            total = sums[(end - 1) % 2]
            if (total[end] - total[start]) % 10 == 0 and end - start < n:
                yield start, end


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Card and phone candidates: from each digit group on, every row of whole groups with as many digits,
    and the Luhn windows of long groups; a group starts at most 13 rows, so they are linear in the text.
    """
    row: list[Span] = []

    def ended() -> Iterator[tuple[str, int, int]]:
        """Rows that start with the first group."""
        start, digits = row[0][0], 0
        start -= start > 0 and text[start - 1] == "("
        start -= start > 0 and text[start - 1] == "+"
        for a, b in row:
            digits += b - a
            if digits in CARD_DIGITS:
                yield "card", start, b
            if digits in PHONE_DIGITS:
                yield "phone", start, b
            if digits >= CARD_DIGITS[-1]:
                break

    held = 0
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        while row and (held >= CARD_DIGITS[-1] or not _JOINT.fullmatch(text, row[-1][1], a)):
            yield from ended()
            first = row.pop(0)
            held -= first[1] - first[0]
        row.append((a, b))
        held += b - a
        yield from (("card", a + i, a + j) for i, j in luhn_windows(m.group()))
    while row:
        yield from ended()
        row.pop(0)


def loose_emails(text: str) -> Iterator[Span]:
    """Names of at most 64 signs, something for the at sign, and a domain with something for its dots."""
    for at in _LOOSE_AT.finditer(text):
        end = at.start()
        if end and text[end - 1] not in _LOCAL and text[end - 1].isspace():
            end -= 1
        start = end
        while start and end - start <= 64 and text[start - 1] in _LOCAL:
            start -= 1
        if 0 < end - start <= 64 and (domain := _LOOSE_DOMAIN.match(text, at.end())):
            yield start, domain.end()


def candidates(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data, many of them overlapping; base spans come first."""
    known = {(kind, *span) for kind in KINDS for span in base[kind]}
    yield from ((kind, *span) for kind in KINDS for span in base[kind])
    yield from (c for span in loose_emails(text) if (c := ("email", *span)) not in known)
    if _DIGIT.search(text):
        yield from (c for m in _LOOSE_IP.finditer(text) if (c := ("ip", *m.span())) not in known)
        yield from (c for c in numbers(text) if c not in known)


# --- features ----------------------------------------------------------------------------------

_HINTS = {"email": ("mail", "contact", "write", "correo"), "ip": ("ip", "host", "server", "addr"),
          "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
          "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "móvil")}
_NOISE = ("version", "token", "license", "sha", "hash", "key", "id", "isbn", "order", "=")
FEATURES = ("kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "groups", "longest_group",
            "first_group", "last_group", "luhn", "octets", "plus", "brackets", "dashes", "dots", "spaces", "at_sign",
            "at_word", "letters", "distinct_digits", "before_alnum", "after_alnum", "before_digit_sign", "hint", "noise",
            "context_digits", "word_ends_short", "joined_before", "joined_after", "four_groups", "longest_joint")


_JOINED_BEFORE, _JOINED_AFTER = re.compile(r"[0-9][\x20().\-/_·]{0,2}\Z"), re.compile(r"[\x20().\-/_·]{0,2}[0-9]")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span and its surroundings, in the order of ``FEATURES``."""
    span = text[start:end]
    groups = _NUMBER.findall(span)
    digits = "".join(groups)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    around = before.lower()
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    last, first = before[-1:], after[:1]
    return [*(float(kind == k) for k in KINDS), float(min(len(span), 100)), float(len(digits)), float(min(len(groups), 20)),
            float(min(max(map(len, groups), default=0), 40)), float(min(len(groups[0]), 40) if groups else 0),
            float(min(len(groups[-1]), 40) if groups else 0), float(bool(digits) and luhn(digits)), float(octets),
            float(span.startswith("+")), float("(" in span), float(min(span.count("-"), 10)), float(min(span.count("."), 10)),
            float(min(span.count(" "), 10)), float(span.count("@")), float(bool(re.search(r"\bat\b", span, re.I))),
            float(min(sum(c.isalpha() for c in span), 60)), float(len(set(digits))), float(last.isalnum()),
            float(first.isalnum()), float(last != "" and last in ".-+/=#$"), float(any(h in around for h in _HINTS[kind])),
            float(any(h in around for h in _NOISE)), float(sum(c.isdigit() for c in before + after)),
            float(len(re.split(r"[.\s]", span)[-1]) <= 4), float(bool(_JOINED_BEFORE.search(before))),
            float(bool(_JOINED_AFTER.match(after))), float(len(groups) > 1 and all(len(g) == 4 for g in groups)),
            float(min(max(map(len, _NUMBER.split(span)[1:-1]), default=0), 9))]


#: Ways in which base spans are also written, shown to the trees as examples of their kind.
_VARIANTS = {"email": (("@", " at "), ("@", "(at)"), ("@", "[at]")), "ip": ((".", "[.]"),),
             "card": (), "phone": (("+", ""), ("+", "00"))}
#: Numbers that stand next to a card or a phone number, before and behind it.
_NEIGHBOURS = {"card": (("", " 12/27"), ("", "/123"), ("2024-05-01 ", ""), ("", " {}")),
               "phone": (("", " 2024-05-01"), ("", "/12"), ("17 ", ""), ("", " {}"))}


def beside(head: str, span: str, tail: str, kind: str) -> Iterator[tuple[list[float], float, str]]:
    """Examples of a card or phone number with another number next to it: the span itself is of its kind, other
    candidates that overlap it are none."""
    for before, behind in _NEIGHBOURS[kind]:
        before, behind = before.format(span), behind.format(span)
        text, start = head + before + span + behind + tail, len(head) + len(before)
        end = start + len(span)
        yield features(text, kind, start, end), 1.0, kind
        for other, a, b in numbers(text):
            if a < end and b > start and (a, b) != (start, end):
                # The number beside it may be the same one again.
                if other != kind or text[a:b] != span:
                    yield features(text, other, a, b), 0.0, other


def examples(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[list[float], float, str]]:
    """(features, label, kind) of a text's candidates: base spans are of their kind, others are not.

    Each base span is also shown rewritten in the ways of ``_VARIANTS``, and spoiled: a card or address with
    digits that fail its test, a phone number run together with letters. Cards and phone numbers also stand
    beside other numbers.
    """
    known = {(kind, *span) for kind in KINDS for span in base[kind]}
    for kind, start, end in candidates(text, base):
        inside = any(s <= start and end <= e or start <= s and e <= end for s, e in base[kind])
        if (kind, start, end) in known or not inside:
            yield features(text, kind, start, end), float((kind, start, end) in known), kind
    for kind in KINDS:
        for start, end in base[kind]:
            head, span, tail = text[max(0, start - CONTEXT):start], text[start:end], text[end:end + CONTEXT]
            for old, new in _VARIANTS[kind]:
                other = span.replace(old, new, 1 if kind != "ip" else -1)
                yield features(head + other + tail, kind, len(head), len(head) + len(other)), 1.0, kind
            if kind in _NEIGHBOURS:
                yield from beside(head, span, tail, kind)
            if kind == "card":
                # The same card in fours, or unbroken.
                joint = "" if "-" in span or " " in span else " -"[len(text) % 2]
                other = joint.join(re.findall("[0-9]{1,4}", digits_of(span)))
                yield features(head + other + tail, kind, len(head), len(head) + len(other)), 1.0, kind
                yield from beside(head, other, tail, kind)
            if kind == "card":
                other = span[:-1] + str((int(span[-1]) + 5) % 10)
            elif kind == "ip":
                other = ".".join([*span.split(".")[:3], "9" + span.split(".")[3].zfill(2)[-2:]])
            elif kind == "phone":
                head, other = head.rstrip() + "x", digits_of(span)
            else:
                continue
            yield features(head + other + tail, kind, len(head), len(head) + len(other)), 0.0, kind


# --- trees ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Boosted trees in flat arrays, and each kind's threshold (above 1 where none is precise)."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights):
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                at = node[inner]
                low = x[inner, self.feature[at]] <= self.split[at]
                node[inner] = np.where(low, self.left[at], self.right[at])
            margin += weight * self.value[node]
        return 1 / (1 + np.exp(-2 * margin))


def _flat(model, thresholds: dict[str, float]) -> Trees:
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()
            rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    roots = [add(tree._java_obj.rootNode()) for tree in model.trees]
    table = np.array(rows, dtype=np.float64)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4],
                 np.array(roots), np.array(model.treeWeights), thresholds)


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_candidates: int = SAMPLE_CANDIDATES, precision: float = PRECISION) -> Trees | None:
    """Trees from at most ``sample_docs`` texts and ``sample_candidates`` of their candidates, thresholds from all
    candidates of a quarter of all texts; none if the former have only one label.

    A text's hash decides whether it trains or is held back. Of the others as many are taken for each of ``SIGNS``,
    and as many candidates of each kind and label, both in the order of a hash. Each kind gets the
    lowest threshold whose accepted candidates in the held-back texts have the wanted precision.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    spark = docs.sparkSession
    texts = docs.select(whole_text(text).alias("t")).filter(F.col("t").rlike("|".join(SIGNS))).withColumn("h", F.xxhash64("t"))
    held_back = F.pmod("h", F.lit(HELD)) == 0
    # The cuts are found among the hashes alone, so no task gathers texts; copies of a text count once.
    hashes = written(texts.filter(~held_back).select("h", *(F.col("t").rlike(sign).alias(f"s{i}") for i, sign in enumerate(SIGNS))).distinct(), "pii")
    cuts = [hashes.filter(f"s{i}").select("h").orderBy("h").limit(max(1, sample_docs // len(SIGNS))).agg(F.max("h").alias("cut"))
            .withColumn("sign", F.lit(i)) for i in range(len(SIGNS))]
    cuts = [r for r in reduce(DataFrame.unionByName, cuts).collect() if r.cut is not None]
    if not cuts:
        return None
    taken = reduce(or_, (F.col("t").rlike(SIGNS[r.sign]) & (F.col("h") <= r.cut) for r in cuts))
    each = max(1, sample_candidates // (2 * len(KINDS)))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each kind and label the ``each`` examples of smallest hash that this task meets."""
        kept: dict[tuple[str, float], list[tuple[int, int, list[float]]]] = {(k, y): [] for k in KINDS for y in (0.0, 1.0)}
        for batch in batches:
            for value, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place, (x, y, kind) in enumerate(examples(value, base_spans(value))):
                    # The hash is of text and place, so equal features don't stand together; smallest on top when negated.
                    heap, own = kept[kind, y], -int.from_bytes(blake2b(f"{h}:{place}".encode(), digest_size=7).digest(), "big")
                    if len(heap) < each:
                        heappush(heap, (own, place, x))
                    elif own > heap[0][0]:
                        heapreplace(heap, (own, place, x))
        found = [(-own, x, y, kind) for (kind, y), heap in kept.items() for own, _, x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.list_(pa.float64())),
                                          pa.array([r[2] for r in found], pa.float64()), pa.array([r[3] for r in found], pa.string())],
                                         names=["own", "x", "y", "kind"])

    rows = written(texts.filter(~held_back & taken).dropDuplicates(["h"]).select("t", "h").mapInArrow(
        shown, "own long, x array<double>, y double, kind string"), "pii")
    strata = [rows.filter((F.col("kind") == kind) & (F.col("y") == y)).orderBy("own", "x").limit(each) for kind in KINDS for y in (0.0, 1.0)]
    fitted = sorted(reduce(DataFrame.unionByName, strata).collect(), key=lambda r: (r.own, r.kind, r.y))
    if len({r.y for r in fitted}) < 2:
        return None
    frame = spark.createDataFrame([(Vectors.dense(r.x), r.y) for r in fitted], ["features", "label"]).coalesce(1).cache()
    try:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(frame)
    finally:
        frame.unpersist()
    trees = _flat(model, {})
    shared = spark.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a text's examples by kind, step of the score and label."""
        for batch in batches:
            for value, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, shown = Counter(), examples(value, base_spans(value))
                while found := list(islice(shown, JUDGED)):
                    steps = (shared.value.probability(np.array([x for x, _, _ in found])) * STEPS).astype(int).tolist()
                    counts.update((kind, step, y) for step, (_, y, kind) in zip(steps, found))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(keys), pa.int64()), pa.array([k for k, _, _ in keys], pa.string()), pa.array([s for _, s, _ in keys], pa.int32()),
                     pa.array([y for _, _, y in keys], pa.float64()), pa.array([counts[k] for k in keys], pa.int64())],
                    names=["h", "kind", "step", "y", "n"])

    # Copies of a text have equal counts, of which one stays.
    counts = (texts.filter(held_back).select("t", "h").mapInArrow(scored, "h long, kind string, step int, y double, n long")
              .dropDuplicates(["h", "kind", "step", "y"]).groupBy("kind", "step", "y").agg(F.sum("n").alias("n")).collect())
    return _flat(model, {kind: threshold([(r.step, r.y, r.n) for r in counts if r.kind == kind], precision) for kind in KINDS})


def threshold(counts: list[tuple[int, float, int]], precision: float) -> float:
    """The lowest score, not below one half, from which on accepted candidates have the precision; 2 where none has.

    ``counts`` are (step of the score, label, candidates).
    """
    right, all_ = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for step, y, n in counts:
        right[step] += n * y
        all_[step] += n
    right, all_ = np.cumsum(right[::-1])[::-1], np.cumsum(all_[::-1])[::-1]
    good = np.flatnonzero((right >= precision * all_) & (all_ >= SUPPORT))
    return float(max(0.5, good[0] / STEPS)) if len(good) else 2.0


def select(text: str, trees: Trees | None) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, whether base, probability) of the spans to redact, by kind and start.

    Base spans all stay. Of other candidates at or above their kind's threshold those that touch no base
    span are taken by falling probability, then start, then length, while they don't overlap one taken before.
    Candidates are judged a block at a time, so a text may hold any number of them.
    """
    base = base_spans(text)
    fixed = [(kind, *span) for kind in KINDS for span in base[kind]]
    chosen = [(*span, True, 1.0) for span in fixed]
    if trees:
        taken = sorted((s, e) for _, s, e in fixed)
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, int)

        def free(start: int, end: int) -> bool:
            i = int(np.searchsorted(starts, end)) - 1
            return i < 0 or reach[i] <= start

        others = (c for c in islice(candidates(text, base), len(fixed), None) if free(c[1], c[2]))
        passed = []
        while block := list(islice(others, JUDGED)):
            chance = trees.probability(np.array([features(text, *c) for c in block]))
            passed += [(-p, *c) for p, c in zip(chance, block) if p >= trees.thresholds[c[0]]]
        used: list[Span] = []
        for p, kind, start, end in sorted(passed, key=lambda c: (c[0], c[2], -c[3], KINDS.index(c[1]))):
            i = _place(used, start)
            if (i == 0 or used[i - 1][1] <= start) and (i == len(used) or used[i][0] >= end):
                used.insert(i, (start, end))
                chosen.append((kind, start, end, False, float(-p)))
    return sorted(chosen, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def _place(spans: list[Span], start: int) -> int:
    return bisect_left(spans, (start, -1))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>"


def find(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive), base, probability.

    Null counts as empty and has no spans. ``trees`` come from :func:`train`; without them only base spans
    are found. Repeated rows have equal spans. An input column named ``spans`` is replaced.
    """
    docs = without(docs, "spans")
    (own_text,) = unused(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                               ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "probability")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, stop in blocks_of(texts):
                spans = [[dict(zip(names, s)) for s in select(t, shared.value)] for t in texts[start:stop]]
                yield pa.RecordBatch.from_arrays([c.slice(start, stop - start) for c in batch.columns[:-1]]
                                                 + [pa.array(spans, kind)], names=schema.fieldNames())

    schema = T.StructType(list(docs.schema.fields)).add("spans", T.StructType.fromDDL(f"spans {SPANS}")["spans"].dataType)
    return numbered(docs.select(*columns(docs), whole_text(text).alias(own_text))).mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            if value is not None:
                for kind, start, end in _merged(select(value, shared.value)):
                    value = f"{value[:start]}<{kind}>{value[end:]}"
            out.append(value)
        return pa.array(out, pa.string())

    return docs.withColumn(text, cleaned(F.col(text)))


def _merged(spans: list[tuple]) -> list[tuple[str, int, int]]:
    """Spans from the last to the first, overlapping ones as one of the first one's kind."""
    out: list[tuple[str, int, int]] = []
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], end))
        else:
            out.append((kind, start, end))
    return out[::-1]
