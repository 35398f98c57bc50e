"""Registered queries and pipeline stages on small tables, row by row against brute force; clashing names; draws of any size."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retailflow.llm import exact, mixing, near, negatives, pieces, pii, quality, spelling, urls, warc, wrappers
from retailflow.llm.queries import QUERIES, model_file

WORDS = [a + b for a in ("al", "be", "ga", "de", "zw", "é") for b in ("pha", "ta", "mma", "lta", "lf")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def shout(text):
    return "|".join(w + "!!" for w in text.upper().split())


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): copies, near copies, bad texts, nulls, empties, a long text, repeated rows."""
    out = [(i, prose(i, 40 + i), f"s{i % 4}") for i in range(60)]
    out += [(100 + i, shout(prose(i, 50)), "s1") for i in range(40)]
    base = prose(7, 90)
    out += [(200 + i, base, "s0") for i in range(6)]
    for i in range(8):
        words = prose(8, 120).split()
        words[5 * i] = "changed"
        out.append((300 + i, " ".join(words), None if i % 2 else "s2"))
    out += [(400, None, "s0"), (401, "", None), (402, "one", "s3"), (403, prose(9, 9000), "s3"), (404, "mail a.b@c.example or +1 (555) 010-9999", "s1"),
            (404, "mail a.b@c.example or +1 (555) 010-9999", "s1"), (405, "from 10.0.0.256 and 10.0.0.7, card 4111 1111 1111 1111", "s2")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i < 60), 0) for i in range(140) if i < 60 or i >= 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, span):
    digits = [int(d) for d in re.sub("[^0-9]", "", span)]
    luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in span.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def brute_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m.group())] for k, p in PATTERNS.items()}


# --- brute force ---------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\t-\r]+", text or "")
    parts = [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return tuple(words), collections.Counter(parts)


def near_classes(rows):
    """{row number: class} by all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        (wi, a), (wj, b) = sets[i], sets[j]
        common = sum((a & b).values())
        if wi == wj or common and common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
            up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def scores(rows, folder_labels):
    """Nearest labelled texts by plain cosines, one text at a time."""
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t or "")
    known = sorted((i, y) for i, y in folder_labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in texts)
    space = quality.fit([(texts[i], y) for i, y in known])
    out = {}
    for i, t, _ in rows:
        v = space.latent(quality.terms([t or ""]))[0].astype(float)
        if not t or not v.any():
            out[i] = space.prior
            continue
        cosines = np.array([max(0.0, float(v @ x)) for x in space.vectors.astype(float)])
        best = np.argsort(-cosines, kind="stable")[:quality.NEIGHBOURS]
        w = cosines[best] ** 2
        out[i] = float((w * space.labels[best]).sum() / w.sum()) if w.sum() else space.prior
    return out


# --- queries -----------------------------------------------------------------------------------------


def test_quality_scores(spark, folder, rows):
    got = QUERIES["op1_quality"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    want = scores(rows, {i: int(i < 60) for i in range(140) if i < 60 or i >= 100})
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(want[r.doc_id], abs=2e-2) and r.predicted == int(r.score >= 0.7)


def test_mixing_counts(spark, folder, rows):
    got = QUERIES["op5_mixing"](spark, folder).collect()
    size = [len(re.findall(r"[^\x20\t-\r]+", t or "")) for _, t, _ in rows]
    by_source = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        by_source[s] += n
    order = sorted((s for s in by_source if s is not None)) + [None]
    targets = dict(zip(order, mixing.share_out([by_source[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))],
                                               1.5 * sum(size), 2)))
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size)) and all(targets[s] <= 2 * by_source[s] + 1e-9 for s in order)
    want = sorted((i, n, by_source[s], round(targets[s], 6)) for (i, _, s), n in zip(rows, size))
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in QUERIES["op5_mixing"](spark, folder).collect()}


def test_piece_digests(spark, folder, rows):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or ""), library.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = QUERIES["op6_sentencepiece"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_personal_data_digests(spark, folder, rows):
    got = QUERIES["op7_pii"](spark, folder).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        spans = brute_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in sorted(spans[k])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(filter(None, r.spans.split(",")))


def test_near_classes(spark, folder, rows):
    got = collections.defaultdict(list)
    for r in QUERIES["op10_near_dedup"](spark, folder).collect():
        got[r.doc_id].append((r.class_id, r.class_size, r.kept))
    classes = near_classes(rows)
    members = collections.defaultdict(list)
    for (i, _, _), c in zip(rows, classes):
        members[c].append(i)
    for (i, _, _), c in zip(rows, classes):
        assert got[i] == [(min(members[c]), len(members[c]), i == min(members[c]))] * len(got[i])
    assert max(len(m) for m in members.values()) == 8


# --- pipeline stages: what each keeps of its own input --------------------------------------------------


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_each_stage_keeps_what_it_should(spark, folder, rows):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("__of", F.lit(1))
    kept = stages["quality"](spark, docs, folder)
    good = {r.doc_id for r in QUERIES["op1_quality"](spark, folder).collect() if r.predicted}
    assert plain(kept) == sorted((r for r in rows if r[0] in good), key=repr) and kept.columns == docs.columns
    assert not {i for i in good if 100 <= i < 140} and len({i for i in good if i < 60}) > 50

    kept = stages["exact_dedup"](spark, docs, folder)
    last = {}
    for i, t, s in rows:
        last[t or ""] = max(last.get(t or "", (-1, None, None)), (i, t, s), key=lambda r: r[0])
    assert plain(kept) == sorted(last.values(), key=repr)

    kept = stages["near_dedup"](spark, docs, folder)
    classes = near_classes(rows)
    first = {}
    for r, c in zip(rows, classes):
        first[c] = min(first.get(c, r[0]), r[0])
    assert plain(kept) == sorted((r for r, c in zip(rows, classes) if r[0] == first[c]), key=repr)

    mixed = stages["mixing"](spark, docs, folder)
    counted = collections.Counter()
    for r in QUERIES["op5_mixing"](spark, folder).dropDuplicates(["doc_id"]).collect():
        counted[r.doc_id] = r.taken
    words = collections.Counter()
    texts = {i: (t or "").split() for i, t, _ in rows}
    copies = collections.Counter(i for i, _, _ in rows)
    for r in mixed.collect():
        own = r.text.split()
        assert own and not collections.Counter(own) - collections.Counter(texts[r.doc_id]) and r.n_chars == len(r.text)
        words[r.doc_id] += len(own) / copies[r.doc_id]
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in counted.items() if n}

    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    for r in stages["sentencepiece"](spark, docs, folder).collect():
        assert r.ids[-1] == library.eos_id() and r.text == library.decode(r.ids)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name


# --- clashing names ------------------------------------------------------------------------------------

ODD = ["__text", "__labelled", "__order", "__quality", "__hash", "__salt", "__repeat", "__source", "__id", "__row", "__pass", "__of", "__key",
       "__maybe", "__keep", "best", "__host", "__passed", "__keys", "__hits", "__ends", "__flags", "__encoded", "__spans", "a.b", "order", "labelled"]
DOCS = [(1, "alpha beta gamma delta one two three", "s"), (2, "alpha beta gamma delta one two three", "s"), (3, None, None)]


@pytest.mark.parametrize("name", ["quality", "exact", "mixing", "pieces", "pii", "near", "warc", "urls", "wrappers", "spelling", "negatives"])
def test_columns_of_any_name_pass(spark, name):
    values = [F.lit(f"own {c}").alias(c) for c in ODD]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").select("*", *values)
    pages = docs.selectExpr("doc_id as page_id", "concat('http://x.com/', doc_id) as url", "text as html", *[f"`{c}`" for c in ODD])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    made = {"quality": lambda: quality.score(docs, labels), "exact": lambda: exact.mark_copies(docs), "mixing": lambda: mixing.mix_documents(docs),
            "pieces": lambda: pieces.encode(docs, model_file()), "pii": lambda: pii.find(docs), "near": lambda: near.drop_near_copies(docs),
            "warc": lambda: warc.mark_revisits(pages), "urls": lambda: urls.judge(pages), "wrappers": lambda: wrappers.extract(pages),
            "spelling": lambda: spelling.group_variants(docs),
            "negatives": lambda: negatives.integer_rows(docs.withColumn("vec_id", F.col("doc_id")).withColumn("label", F.lit(1))
                                                        .withColumn("embedding", F.array(F.lit(1.0))))}[name]()
    got = made.collect()
    if name in ("spelling", "negatives"):
        return  # they return rows of their own
    assert got and set(ODD) <= set(made.columns)
    assert all(r[c] == f"own {c}" for r in got for c in ODD)


# --- draws beyond numpy's range -----------------------------------------------------------------------


def test_draws_of_any_size_have_the_right_spread(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_SLOTS", 10)  # all by the method for large numbers
    random_ = np.random.Generator(np.random.Philox(3))
    for good, bad, taken in ((30, 70, 40), (3, 5000, 700), (2_000_000_000, 5_000_000_000, 1_000_000)):
        drawn = np.array([mixing.hypergeometric(random_, good, bad, taken) for _ in range(4000)], float)
        p = good / (good + bad)
        variance = taken * p * (1 - p) * (good + bad - taken) / (good + bad - 1)
        assert drawn.min() >= max(0, taken - bad) and drawn.max() <= min(good, taken)
        assert abs(drawn.mean() - taken * p) < 5 * (variance / 4000) ** 0.5
        assert drawn.var() == pytest.approx(variance, rel=0.15)
    counts = np.array([4_000_000_000, 7, 0, 9_000_000_000])
    left = mixing.split_counts(counts, 6_500_000_000, (1, 2))
    assert left.sum() == 6_500_000_000 and (left <= counts).all() and (left >= 0).all()
    assert (left == mixing.split_counts(counts, 6_500_000_000, (1, 2))).all()
