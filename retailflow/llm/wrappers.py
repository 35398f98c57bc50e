"""Main text of web pages by wrapper induction over the pages of a host.

A page is folded to its shape: the tree of its containers (``div``, ``article``, ``nav`` and so on), with a
slot for each run of text between them. Shapes of a host are aligned by simple tree matching and merged
into its wrapper, which counts what its slots held on all pages. Slots whose text never changes are
template; of the varying ones those of the main container are content, unless their container is
by its name a menu, an advert, a comment list or the like. Pages of one shape share the decision.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.llm.common import columns, unused, written
from retailflow.llm.urls import host_and_path

# Elements by what they do to text, and the words of classes, ids and roles that name page parts.
SKIPPED = frozenset("button canvas head iframe math noscript object script select style svg template textarea".split())
RAW = frozenset("iframe noscript script style textarea".split())
CONTAINERS = frozenset("article aside body dialog div fieldset footer form header html main menu nav section".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PAGE_PARTS = frozenset("aside dialog footer form header menu nav".split())
PART_WORDS = frozenset("ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent "
                       "contentinfo complementary cookie cookies disqus footer form header login masthead menu menubar modal nav navbar "
                       "navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply "
                       "respond search share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget widgets".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
NEGATIONS = frozenset("has no with without".split())

#: Containers below this depth count as text of the one at it.
DEPTH = 64
#: Neighbours of one label that are folded to one when they have a class, and when they have none.
FOLD_NAMED, FOLD_PLAIN = 2, 9
#: Pages on which a slot must have been the same to be template.
SEEN = 3
#: Share of link text from which a slot outside an article is a menu, and share of a container's text from
#: which a part of it is looked into.
LINKED, INNER = 0.5, 0.8
#: Parts in which the shapes of a host are merged before they meet.
SALTS = 64
#: Cells of the alignment of two lists that are held at once; of longer lists rows are made twice.
CELLS = 1 << 20
#: Bytes of decisions up to which they are broadcast; above, they join by host and shape.
BROADCAST = 32 << 20
#: Shapes that a task counts before it sends them.
HELD = 20_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_ENDS = {tag: re.compile(f"</{tag}[^<>]*>", re.IGNORECASE) for tag in RAW}


# --- a page's shape ----------------------------------------------------------------------------

class Slot:
    """A run of text between containers: its place on the page, its pieces, and how much of them is in links."""

    __slots__ = ("place", "pieces", "linked", "text")

    def __init__(self, place: int) -> None:
        self.place, self.linked, self.text = place, 0, ""
        self.pieces: list[str] = []

    def finish(self) -> None:
        self.text = " ".join("".join(self.pieces).split())
        self.pieces = []


class Node:
    """A container with its children in order; a slot is a child of the label ``#``."""

    __slots__ = ("label", "kids", "slots", "stats")

    def __init__(self, label: str, kids: list[Node] | None = None, slots: list[Slot] | None = None, stats: list | None = None):
        self.label, self.kids, self.slots, self.stats = label, kids or [], slots or [], stats

    def shape(self) -> list:
        return [self.label, [k.shape() for k in self.kids]]


def label_of(tag: str, attributes: str) -> str:
    """Element name and the words of class, id, role and itemprop; numbers in them don't count."""
    words = []
    for _, a, b, c in _NAMES.findall(attributes) if "=" in attributes else ():
        words += re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return " ".join([tag, *dict.fromkeys(words)])


def is_part(label: str, inside_main: bool) -> bool:
    """Whether a container is by its name a menu, header, advert, comment list or another part beside the article."""
    tag, *words = label.split(" ")
    if inside_main and tag == "header":
        return False  # the article's own heading
    if tag in PAGE_PARTS:
        return True
    main = not MAIN_WORDS.isdisjoint(words)
    for before, word in zip(["", *words], words):
        if word in PART_WORDS and before not in NEGATIONS and not (word == "header" and (main or inside_main)):
            return True
    return False


def is_main(label: str) -> bool:
    tag, *words = label.split(" ")
    return tag in ("article", "main") or words == ["main"] or "articlebody" in "".join(words)


def page_tree(html: str) -> Node:
    """The containers and slots of a page; markup may be broken in any way.

    A start tag of a block ends an open paragraph; an end tag closes the innermost open element of its name
    and those within, within its container; without an open element it says nothing. Comments, scripts, styles, hidden
    elements and controls are left out.
    """
    root = Node("html")
    open_: list[tuple[str, bool]] = []  # (name, whether it is a container of its own)
    path, slot, links, at, skipping = [root], None, 0, 0, 0

    def add(piece: str) -> None:
        nonlocal slot
        if slot is None:
            if not piece.strip():
                return
            slot = Slot(at)
            path[-1].kids.append(Node("#", slots=[slot]))
        slot.pieces.append(entities.unescape(piece) if "&" in piece else piece)
        if links:
            slot.linked += len(piece)

    def close(until: int) -> None:
        nonlocal slot, links, skipping
        while len(open_) > until:
            name, own = open_.pop()
            links -= name == "a"
            skipping = skipping if len(open_) >= skipping else 0
            if own:
                path.pop()
                slot = None
            elif name not in INLINE and slot is not None:
                slot.pieces.append("\n")

    while True:
        found = _TAG.search(html, at)
        if not skipping:
            piece = html[at:found.start() if found else len(html)]
            if piece:
                add(piece)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
                if open_[i][1] and tag not in CONTAINERS:
                    break  # elements don't end outside their container
            else:
                if tag == "p" and slot is not None and not skipping:
                    slot.pieces.append("\n")
            continue
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            if slot is not None and not skipping and tag not in ("wbr", "img"):
                slot.pieces.append("\n")
            continue
        if tag in ("html", "body"):
            continue  # there is one of each, whatever the markup says
        if tag == "head" or attributes.endswith("/") and tag not in CONTAINERS:
            continue
        if tag not in INLINE:
            for i in range(len(open_) - 1, -1, -1):
                name, own = open_[i]
                if own or (tag in ("li", "dd", "dt", "td", "th", "tr", "option") and name in ("ul", "ol", "dl", "table")):
                    break
                if name == "p" or name == tag and tag in ("li", "dd", "dt", "td", "th", "tr"):
                    close(i)
                    break
            if slot is not None and not skipping:
                slot.pieces.append("\n")
        own = tag in CONTAINERS and not skipping and len(path) < DEPTH
        if own:
            node = Node(label_of(tag, attributes))
            path[-1].kids.append(node)
            path.append(node)
            slot = None
        open_.append((tag, own))
        links += tag == "a"
        if not skipping and (tag in SKIPPED or tag == "title" or attributes and _HIDDEN.search(attributes)):
            skipping = len(open_)
    return fold(root)


def fold(node: Node) -> Node:
    """Drop slots and containers without text, and fold runs of equal neighbours to one.

    Records of a list (comments, say) have one label with a class and differ a little: each run of two is
    merged. Containers without a class are told apart by their place, so only long runs of one shape are folded.
    """
    kids: list[Node] = []
    for kid in node.kids:
        if kid.label == "#":
            kid.slots[0].finish()
            if kid.slots[0].text:
                kids.append(kid)
        else:
            kid = fold(kid)
            if kid.kids:
                kids.append(kid)
    out: list[Node] = []
    i = 0
    while i < len(kids):
        j = i + 1
        named = " " in kids[i].label or kids[i].label == "article"
        shape = None if named else kids[i].shape()
        while j < len(kids) and kids[j].label == kids[i].label != "#" and (named or kids[j].shape() == shape):
            j += 1
        if j - i >= (FOLD_NAMED if named else FOLD_PLAIN):
            first = kids[i]
            for other in kids[i + 1:j]:
                first = merge(first, other)
            out.append(first)
        else:
            out += kids[i:j]
        i = j
    node.kids = out
    return node


def slots_of(node: Node) -> Iterator[Node]:
    """The slots below a node, in page order of where they first are."""
    stack = [node]
    while stack:
        top = stack.pop()
        if top.label == "#":
            yield top
        stack += reversed(top.kids)


# --- simple tree matching -----------------------------------------------------------------------

def matched(a: Node, b: Node) -> int:
    """Size of the largest order-keeping match of two trees whose roots have one label.

    A slot that held the same on all pages of both counts twice: among equal shapes it tells which are the same.
    """
    if a.label != b.label:
        return 0
    if a.stats and b.stats and a.stats[1:3] == b.stats[1:3]:
        return 2
    if not a.kids or not b.kids:
        return 1
    return 1 + aligned(a.kids, b.kids)[0]


def aligned(a: list[Node], b: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """(size, pairs of places) of the best match of two lists of trees that keeps their order.

    One dynamic program for lists of any length, a row of it at a time. Rows are kept for one block of ``a``;
    of the others only their first, from which they are made again, so long lists need memory for about the root of
    their rows.
    """
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b)):
        return len(a) + sum(aligned(x.kids, y.kids)[0] for x, y in zip(a, b) if x.kids and y.kids), [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    step = max(math.isqrt(n) + 1, CELLS // (m + 1))
    labels: dict[str, list[int]] = {}
    same: dict[tuple, list[int]] = {}
    for j, kid in enumerate(b):
        labels.setdefault(kid.label, []).append(j)
        if kid.label == "#" and kid.stats:
            same.setdefault(tuple(kid.stats[1:3]), []).append(j)

    def weights(i: int) -> np.ndarray:
        row, own = np.zeros(m, np.int64), a[i]
        if own.label == "#":  # as matched() has it, for all slots at once
            row[labels.get("#", [])] = 1
            row[same.get(tuple(own.stats[1:3]), []) if own.stats else []] = 2
        else:
            for j in labels.get(own.label, ()):
                row[j] = matched(own, b[j])
        return row

    def block(first: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and best sizes of the rows from ``first``; the last of the sizes is ``below``."""
        last = min(first + step, n)
        weight, best = np.zeros((last - first, m), np.int64), np.zeros((last - first + 1, m + 1), np.int64)
        best[-1] = below
        for i in range(last - first - 1, -1, -1):
            weight[i] = weights(first + i)
            best[i, :m] = np.maximum(best[i + 1, :m], best[i + 1, 1:] + weight[i])
            best[i] = np.maximum.accumulate(best[i, ::-1])[::-1]
        return weight, best

    below = np.zeros(m + 1, np.int64)
    starts = range(0, n, step)
    after: dict[int, np.ndarray] = {}
    weight = best = None
    for first in reversed(starts):
        after[first] = below
        weight, best = block(first, below)
        below = best[0].copy()
    size, j, pairs = int(below[0]), 0, []
    for first in starts:
        if first:
            weight, best = block(first, after[first])
        i, rows = 0, min(step, n - first)
        while i < rows and j < m:  # of equally large matches the one that begins first
            if weight[i, j] and best[i, j] == best[i + 1, j + 1] + weight[i, j]:
                pairs.append((first + i, j))
                i, j = i + 1, j + 1
            elif best[i, j] == best[i + 1, j]:
                i += 1
            else:
                j += 1
    return size, pairs


def joined_stats(a: list | None, b: list | None) -> list | None:
    """[pages, least hash, greatest hash, characters, characters in links]."""
    if not a or not b:
        return a or b
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def merge(a: Node, b: Node) -> Node:
    """The union of two trees along their match; what has no partner stays at its place."""
    kids, i, j = [], 0, 0
    for x, y in [*aligned(a.kids, b.kids)[1], (len(a.kids), len(b.kids))]:
        kids += [*a.kids[i:x], *b.kids[j:y]]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return Node(a.label, kids, a.slots + b.slots, joined_stats(a.stats, b.stats))


def packed(node: Node) -> str:
    """A tree as JSON, with its slots' counts."""
    def plain(n: Node) -> list:
        return [n.label, [plain(k) for k in n.kids], n.stats]
    return json.dumps(plain(node), separators=(",", ":"))


def unpacked(text: str) -> Node:
    def node(plain: list) -> Node:
        return Node(plain[0], [node(k) for k in plain[1]], None, plain[2])
    return node(json.loads(text))


# --- which slots are content ----------------------------------------------------------------------

def decide(wrapper: Node) -> None:
    """Mark each slot of a wrapper, in its stats' last place: content (true) or not.

    The main containers are the outermost articles, else what is called main. Without any it is the innermost
    container that has most of the varying text outside links and other parts of the page. Within it,
    named parts go, and slots that never changed while others of it did.
    """
    slots: list[tuple[Node, bool, str]] = []  # slot, whether it is in a named part, the main container it is in

    def walk(node: Node, part: bool, main: str) -> None:
        if node.label == "#":
            slots.append((node, part, main))
            return
        part = part or is_part(node.label, bool(main))
        if not part and is_main(node.label):
            main = "article" if main == "article" or node.label.split(" ")[0] == "article" else "main"
        for kid in node.kids:
            walk(kid, part, main)

    walk(wrapper, False, "")
    explicit = next((kind for kind in ("article", "main") if any(m == kind and not part for _, part, m in slots)), None)

    def useful(slot: Node) -> int:
        n, low, high, chars, linked = slot.stats[:5]
        return 0 if linked > LINKED * chars else chars - linked

    parts = {id(slot) for slot, part, _ in slots if part}
    if explicit:
        inner = {id(slot) for slot, _, main in slots if main == explicit}
    else:
        varying = {id(s) for s, _, _ in slots if s.stats[1] != s.stats[2]}
        free = {id(s): useful(s) for s, part, _ in slots if not part}
        if any(free[i] for i in free if i in varying):
            free = {i: n for i, n in free.items() if i in varying}
        node = wrapper
        while True:
            total = sum(free.get(id(s), 0) for s in slots_of(node))
            below = [k for k in node.kids if k.label != "#" and sum(free.get(id(s), 0) for s in slots_of(k)) >= INNER * total]
            if not below or not total:
                break
            node = below[0]
        inner = {id(s) for s in slots_of(node) if id(s) in free and free[id(s)] > 0}
    chosen = [s for s, _, _ in slots if id(s) in inner and id(s) not in parts]
    varies = any(s.stats[1] != s.stats[2] for s in chosen)
    content = {id(s) for s in chosen if s.stats[1] != s.stats[2] or s.stats[0] < SEEN or not varies}
    for slot, _, _ in slots:
        slot.stats = [*slot.stats[:5], id(slot) in content]


def roles(shape: Node, wrapper: Node) -> list[bool]:
    """Which slots of a shape are content, by those of the wrapper that they are aligned with.

    A shape with nothing in the main container of its host is decided by itself.
    """
    found: dict[int, bool] = {}

    def follow(own: Node, of: Node) -> None:
        if own.label == "#":
            found[id(own)] = bool(of.stats[5])
        for x, y in aligned(own.kids, of.kids)[1]:
            follow(own.kids[x], of.kids[y])

    follow(shape, wrapper)
    slots = list(slots_of(shape))
    if not any(found.values()):
        decide(shape)
        return [s.stats[5] for s in slots]
    return [found.get(id(s), False) for s in slots]


# --- the work on tables -----------------------------------------------------------------------------

def key_of(host: str, tree: Node) -> int:
    return xxhash.xxh3_64_intdigest(json.dumps([host, tree.shape()])) - (1 << 63)


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _strings(column: pa.Array) -> list[str]:
    return [s or "" for s in column.to_pylist()]


def shapes(pages: DataFrame) -> DataFrame:
    """(host, key, shape, slot, n, low, high, chars, linked): what the slots of each shape of a host held.

    From (host, html). Tasks count per shape first, so a host with a third of all pages sends one row per
    task, shape and slot.
    """
    names = ["host", "key", "shape", "slot", "n", "low", "high", "chars", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[str, str, list]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(host, key, shape, i, *s) for key, (host, shape, stats) in held.items() for i, s in enumerate(stats)]
            parts = list(zip(*flat)) or [()] * len(names)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], names=names)

        for batch in batches:
            for host, html in zip(_strings(batch.column(0)), _strings(batch.column(1))):
                tree = page_tree(html)
                key, stats = key_of(host, tree), []
                for node in slots_of(tree):
                    texts = [s.text for s in node.slots]
                    h = _text_hash("\n".join(texts))
                    stats.append([1, h, h, sum(map(len, texts)), sum(s.linked for s in node.slots)])
                if key in held:
                    stats = [joined_stats(a, b) for a, b in zip(held[key][2], stats)]
                held[key] = (host, json.dumps(tree.shape(), separators=(",", ":")), stats)
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    sent = pages.mapInArrow(run, "host string, key long, shape string, slot int, n long, low long, high long, chars long, linked long")
    return sent.groupBy("host", "key", "slot").agg(
        F.first("shape").alias("shape"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))


def with_stats(shape: str, slots: list[dict]) -> Node:
    """The tree of a shape with the counts of its slots in order."""
    def node(plain: list) -> Node:
        return Node(plain[0], [node(k) for k in plain[1]])
    tree = node(json.loads(shape))
    for own, s in zip(slots_of(tree), sorted(slots, key=lambda s: s["slot"])):
        own.stats = [s["n"], s["low"], s["high"], s["chars"], s["linked"]]
    return tree


def _merged(last: bool):
    def run(table: pa.Table) -> pa.Table:
        wrapper = None
        for text in sorted(table.column("tree").to_pylist()):
            tree = unpacked(text)
            wrapper = tree if wrapper is None else merge(wrapper, tree)
        if last:
            decide(wrapper)
        return pa.table({"host": table.column("host").slice(0, 1), "tree": pa.array([packed(wrapper)], pa.string())})
    return run


def decisions(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(key, content): for each shape of a host which of its slots are content.

    Shapes of a host are merged in ``salts`` parts first and then once more, so no task gathers all shapes of a
    host; every shape takes part. A wrapper is as large as the distinct structure of its host's pages.
    """
    @F.arrow_udf(T.StringType())
    def tree(shape: pa.Array, slots: pa.Array) -> pa.Array:
        return pa.array([packed(with_stats(a, b)) for a, b in zip(shape.to_pylist(), slots.to_pylist())], pa.string())

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def content(own: pa.Array, wrapper: pa.Array) -> pa.Array:
        known: dict[str, Node] = {}
        out = []
        for a, b in zip(own.to_pylist(), wrapper.to_pylist()):
            if b not in known:
                known = {b: unpacked(b)}
            out.append(roles(unpacked(a), known[b]))
        return pa.array(out, pa.list_(pa.bool_()))

    slot = F.struct("slot", "n", "low", "high", "chars", "linked")
    found = (shapes(pages).groupBy("host", "key").agg(F.first("shape").alias("shape"), F.collect_list(slot).alias("slots"))
             .withColumn("tree", tree("shape", "slots")).withColumn("salt", F.pmod(F.col("key"), F.lit(salts))))
    trees = written(found.select("host", "key", "salt", "tree"), "shapes")
    parts = trees.groupBy("host", "salt").applyInArrow(_merged(False), "host string, tree string")
    hosts = parts.groupBy("host").applyInArrow(_merged(True), "host string, tree string").select(
        F.col("host").alias("of"), F.col("tree").alias("wrapper"))
    spread = hosts.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (trees.join(spread, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("cell")))
            .select("key", content("tree", "wrapper").alias("content")))


@F.arrow_udf(T.LongType())
def page_key(host: pa.Array, html: pa.Array) -> pa.Array:
    return pa.array([key_of(a, page_tree(b)) for a, b in zip(_strings(host), _strings(html))], pa.int64())


def main_text(html: str, content: list[bool] | None) -> str:
    """The text of the content slots, in page order."""
    taken = [s for node, own in zip(slots_of(page_tree(html)), content or ()) if own for s in node.slots]
    return " ".join(s.text for s in sorted(taken, key=lambda s: s.place))


def extract(pages: DataFrame, html: str = "html", url: str = "url", salts: int = SALTS, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Null and empty pages have an empty text. Pages without a host in their URL count as those of one
    host. Equal and repeated pages get equal texts; on a host whose pages don't differ nothing tells template from
    content but the names of containers. An empty table gives an empty result. Input columns named like the
    results are replaced, all others pass through.

    The decisions for the shapes of all hosts are written and broadcast if they are small, else they join by key
    and a salt. Within a block white space becomes one space, blocks are joined by one.
    """
    own_key, own_salt, own_content = unused(pages, "key", "salt", "content")
    host, kept = host_and_path(F.col(url))[0], columns(pages.drop("text", "n_chars"))
    chosen = written(decisions(pages.select(host.alias("host"), F.col(html).alias("html")), salts), "decisions")
    size = chosen.agg(F.sum(F.size("content") + 24).alias("n")).collect()[0].n or 0
    chosen = chosen.select(F.col("key").alias(own_key), F.col("content").alias(own_content))
    keyed = pages.withColumn(own_key, page_key(host, F.col(html)))
    if size <= broadcast_bytes:
        joined = keyed.join(F.broadcast(chosen), own_key, "left")
    else:
        keyed = keyed.withColumn(own_salt, F.pmod(F.xxhash64(F.col(html), F.col(url)), F.lit(salts)).cast("int"))
        chosen = chosen.withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.join(chosen, [own_key, own_salt], "left")

    @F.arrow_udf(T.StringType())
    def text(html: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([main_text(a, b) for a, b in zip(_strings(html), content.to_pylist())], pa.string())

    return joined.select(*kept, text(F.col(html), F.col(own_content)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
