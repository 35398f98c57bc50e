"""Hard negatives, spelling variants, main text of pages: against brute force on small fixtures."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailflow.llm import negatives, spelling, wrappers
from retailflow.llm.queries import QUERIES

# --- hard negatives ---------------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives_=5, percent=80):
    """Brute force over {id: (label, vector)}."""
    out = set()
    for a in anchors:
        label, vector = rows[a]
        scored = sorted(((-int(np.dot(vector, v)), i, l) for i, (l, v) in rows.items() if i != a and len(v) == len(vector)))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(s, j) for s, j, l in scored if l != label and percent * -p <= 100 * -s <= 100 * -p][:negatives_]
            out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)}
    return out


def embeddings(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>, label int, __extra string")


def test_hard_negatives_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    values = []
    for i in range(420):
        v = centres[i % 6] + rng.normal(size=8) * 0.4
        values.append((i, (v / np.linalg.norm(v)).round(2).tolist(), int(rng.integers(4)), "x"))
    values[10] = (10, values[3][1], 0, "x")  # ties
    values[11] = (11, values[3][1], 1, "x")
    odd = [(1000, None, 1, "x"), (1001, [1.0] * 7 + [None], 1, "x"), (1002, [1.0] * 7 + [float("nan")], 1, "x"),
           (1003, [1.0] * 8, None, "x"), (None, [1.0] * 8, 1, "x"), (1100, [0.5] * 3, 1, "x"), values[5], (1200, [], 1, "x")]
    embeddings(spark, values + odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = {}
    for i, v, l, _ in values + [odd[5], odd[7]]:
        rows[i] = ((l + 1) % 10 if i % 7 == 0 else l, np.floor(256 * np.array(v, np.float32).astype(float)))
    got = [tuple(r) for r in QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, [i for i in rows if i % 100 == 0])
    # Blocks of any size give the same rows.
    own = negatives.integer_rows(spark.read.parquet(str(tmp_path / "embeddings.parquet")))
    plain = {i: (l, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, l, _ in values + [odd[5], odd[7]]}
    small = negatives.mine(own, own.filter("vec_id % 50 = 0"), candidates_per_task=70, anchors_per_task=3, centres=4, sample=50)
    assert {tuple(r) for r in small.collect()} == mined(plain, [i for i in plain if i % 50 == 0])


def test_the_heap_skips_cells_of_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 100
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)))
    books = negatives.centres_of(x[:500, :8]), negatives.centres_of(x[:500, 8:])
    index = negatives.MultiIndex(np.arange(4000), np.zeros(4000, int), x, books)
    read = 0
    walk = index.cells

    def counted(q):
        nonlocal read
        bound = np.inf
        for cell in walk(q):
            assert cell[0] <= bound  # cells come by falling bound
            bound = cell[0]
            scores = index.x[cell[2]:cell[3]] @ q
            assert scores.max() <= cell[0] and scores.min() >= cell[1]
            read += cell[3] - cell[2]
            yield cell
    index.cells = counted
    for q in x[:20]:
        (ids, scores), = index.search(q, lambda rows: np.ones(len(rows), bool), np.array([-np.inf]), np.array([np.inf]), 5)
        assert scores.tolist() == sorted((x @ q).tolist(), reverse=True)[:5]
    assert read < 20 * 4000 / 4


def test_no_anchors_or_vectors_give_no_rows(spark):
    none = negatives.integer_rows(embeddings(spark, []))
    assert negatives.mine(none, none).collect() == []
    one = negatives.integer_rows(embeddings(spark, [(100, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 2, "x")]))
    assert negatives.mine(one, one.filter("vec_id = 100")).collect() == []


# --- spelling variants ----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(texts):
    """Brute force over [(id, text)]."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}
    n = Counter()
    for doc_id, text in texts:
        for run in "".join(c if c in letters else " " for c in text or "").split():
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["Straßé", "naïveté", "x" * 3000]
    texts = []
    for i in range(700):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            kind, at = rng.random(), rng.randrange(len(w))
            if kind < 0.05:
                w = w[:at] + rng.choice("abz") + w[at:]
            elif kind < 0.1:
                w = w[:at] + w[at + 1:]
            elif kind < 0.15:
                w = w[:at] + "q" + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, ", ".join(words)))
    return texts + [(700, None), (701, ""), (702, "1234 ×"), (None, " ".join(["nameless"] * 6)), texts[0], texts[0]]


def test_variants_equal_brute_force(spark, spelled, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in spelled], "doc_id long, text string, word string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op12_spelling"](spark, str(tmp_path)).collect()]
    want = grouped(spelled)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[1] for w in want) and any(w[2] != (w[1] or w[0]) for w in want)  # forms, and chains of them
    # Small leaves, split leaves and a sample that knows little of the words lose nothing.
    small = spelling.group_variants(df, leaf_words=8, task_queries=5, sample=40)
    assert {tuple(r) for r in small.collect()} == want


def test_leaves_hold_all_words_within_reach():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(7)) for _ in range(900)})
    tree = spelling.TopTree.fit(words[:300], len(words), 20)
    counts = spelling.letter_counts(spelling.letters_of(words), tree.alphabet)
    rows, leaves = tree.leaves(7, counts, 0)
    home = dict(zip(rows.tolist(), leaves.tolist()))
    assert len(home) == len(rows) == len(words) and len(set(home.values())) > 8
    asked = set(zip(*(x.tolist() for x in tree.leaves(7, counts, 2))))
    for i, j in zip(*np.nonzero(np.abs(counts[:, None] - counts[None]).sum(axis=2) <= 2)):
        assert (i, home[j]) in asked


def test_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(df).collect() == []


# --- main text --------------------------------------------------------------------------------------

ARTICLE = ("<html><head><title>t{n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/>home {n}</a></nav>"
           "<div class='ad'>buy {n}</div><article><h1>Title {n}</h1><p>First &amp; {n}<br>line<p><b>Second  {n}</p><div class=\"share-box\">tell {n}"
           "</div><p>Third {n}</p></article><section id=comments><p>reader {n}</p></section><footer>&copy; {n}</footer>")


def texts(df, **options):
    return {r.page_id: r.text for r in wrappers.extract(df, **options).collect()}


def pages(spark, values, extra="page_id long, url string, html string, __key string, text int"):
    return spark.createDataFrame([(*v, "k", 1) for v in values], extra)


def test_articles_without_the_rest(spark):
    df = pages(spark, [(n, f"http://a.example/{n}", ARTICLE.format(n=n)) for n in range(6)])
    want = {n: f"Title {n} First & {n} line Second {n} Third {n}" for n in range(6)}
    assert texts(df) == want
    assert texts(df, broadcast_bytes=0, salts=3) == want  # decisions that don't fit a broadcast are joined
    out = wrappers.extract(df)
    assert out.columns == ["page_id", "url", "html", "__key", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_template_of_plain_containers_is_told_by_the_host(spark):
    """No name tells what is what: what never changes is template, and the text is where it varies most."""
    def page(n, extra=""):
        return (f"<body><div>Site name<p>All rights reserved, do read the terms of use before you go on</div><div><div><p>story {n} begins here "
                f"and goes on for a while {n * 7}</p><p>ends {n}</p></div><div>Follow us on paper, by mail and by phone</div>{extra}</div>"
                f"<div><a href=x>more {n}</a> <a href=y>links {n}</a></div></body>")
    values = [(n, "http://b.example/x", page(n, "<div>Seen by all</div>" if n % 2 else "")) for n in range(8)]
    assert texts(pages(spark, values)) == {n: f"story {n} begins here and goes on for a while {n * 7} ends {n}" for n in range(8)}


def test_defined_results_of_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    values = [(1, "http://c.example/", None), (2, None, ""), (3, "no scheme", "<article>alone"), (4, "http://d.example/", "plain < text & more"),
              (5, "http://e.example/", "<article>" + "<p>long words</p>" * 20000), (6, "http://f.example/", f"<article>{deep}</article>"),
              (7, "http://g.example/", "<article><p>a&nbsp;&#65;&lt;b&gt;</p></article></article></p></div>"),
              (8, "http://g.example/", "<article><p>x<!-- <p>no</p> --><script>no</script><p hidden>no</p><form>no</form>y"), (8, "http://g.example/", "<article><p>x<!-- <p>no</p> --><script>no</script><p hidden>no</p><form>no</form>y")]
    got = texts(pages(spark, values))
    assert got[1] == got[2] == "" and got[3] == "alone" and got[4] == "plain < text & more"
    assert got[5] == " ".join(["long words"] * 20000) and got[6] == "deep" and got[7] == "a A<b>" and got[8] == "x y"
    assert wrappers.extract(pages(spark, values)).count() == len(values)
    assert texts(pages(spark, [])) == {}


def test_copies_of_one_page_keep_their_text(spark):
    df = pages(spark, [(n, "http://h.example/", ARTICLE.format(n=1)) for n in range(9)])
    assert set(texts(df).values()) == {"Title 1 First & 1 line Second 1 Third 1"}


def test_tree_matching_is_the_largest():
    def tree(plain):
        return wrappers.Node(plain[0], [tree(k) for k in plain[1]])
    a = tree(["d", [["x", []], ["y", [["#", []]]], ["x", [["#", []], ["z", []]]]]])
    b = tree(["d", [["y", [["#", []]]], ["q", []], ["x", [["z", []]]]]])
    assert wrappers.matched(a, b) == 5
    assert wrappers.aligned(a.kids, b.kids)[1] == [(1, 0), (2, 2)]
    assert wrappers.merge(a, b).shape() == ["d", [["x", []], ["y", [["#", []]]], ["q", []], ["x", [["#", []], ["z", []]]]]]


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    """The largest match whatever the lists' length, and the same one however many rows are held."""
    def leaves(names):
        return [wrappers.Node(n) for n in names]
    names = [f"l{i}" for i in range(300)]
    size, pairs = wrappers.aligned(leaves(names), leaves(["l60", *names[:60], *names[61:]]))
    assert size == len(pairs) == 299

    dice = random.Random(3)

    def some(depth):
        if depth and dice.random() < 0.5:
            return wrappers.Node(dice.choice("xy"), [some(depth - 1) for _ in range(dice.randrange(4))])
        h = dice.randrange(3)
        return wrappers.Node("#", stats=[1, h, h, 1, 0] if dice.random() < 0.8 else None)
    for _ in range(150):
        a, b = ([some(2) for _ in range(dice.randrange(12))] for _ in range(2))
        monkeypatch.undo()
        whole = wrappers.aligned(a, b)
        monkeypatch.setattr(wrappers, "CELLS", 1)
        assert wrappers.aligned(a, b) == whole
