"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retailflow.llm import bloom, exact, mixing, near, pieces, pii, quality
from retailflow.llm.queries import model_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "Ünder", "zwölf", "日本", "x", "sun,", "moon.", "12", "a-b"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 300)
    near_copy = base.replace("alpha", "omega", 2)
    rows = [(i, prose(i + 10, 5 + 13 * i), f"s{i % 3}") for i in range(20)]
    rows += [(100 + i, base, "s0") for i in range(30)] + [(200, near_copy, "s1"), (201, near_copy + " end", None)]
    rows += [(300, None, None), (301, "", "s1"), (302, "   \n", "s2"), (303, "one", "s2"), (304, prose(3, 20_000), "s2"),
             (None, base, "s0"), (None, "nobody's text", "s1"), (305, "same row", "s1"), (305, "same row", "s1")]
    return rows


# --- exact copies ----------------------------------------------------------------------------

def test_exact_copies(spark, docs):
    wide = frame(spark, docs).selectExpr("*", "'old' as KEPT", "1 as keep_id", "2 as `a.b`")
    got = exact.mark_copies(wide).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in docs:
        groups[t or ""].append(i)
    assert len(got) == len(docs)
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    kept = collections.Counter(r.text or "" for r in got if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert "a.b" in exact.drop_copies(wide).columns


def test_exact_copies_with_a_full_filter(spark, docs):
    # One block for all hashes lets most rows through; the result is the same.
    few = exact.mark_copies(frame(spark, docs), most_bytes=8192)
    assert sorted(few.collect(), key=str) == sorted(exact.mark_copies(frame(spark, docs)).collect(), key=str)


def test_filter_loses_no_repeat(spark):
    rng = np.random.default_rng(0)
    once, twice = rng.integers(-2**62, 2**62, 5000), rng.integers(-2**62, 2**62, 300)
    df = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(7)
    bits = bloom.build(df, "h", 5600, times=2)
    assert bloom.contains(bits, twice).all()
    assert bloom.contains(bits, once).mean() < 0.02


# --- near copies -------------------------------------------------------------------------------

def brute_classes(rows, similarity=0.8):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        union = sum((sets[a] | sets[b]).values())
        if not union or sum((sets[a] & sets[b]).values()) / union >= similarity:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_against_all_pairs(spark, docs):
    rows = [r for r in docs if r[0] is not None]
    rng = random.Random(5)
    for group in range(6):  # chains of copies that drift away from the first
        words = prose(1000 + group, 80).split()
        for step in range(25):
            words[rng.randrange(len(words))] = f"new{group}_{step}"
            rows.append((1000 + 100 * group + step, " ".join(words), "s0"))
    shared = prose(77, 60)  # a passage in many otherwise different texts
    rows += [(5000 + i, f"{prose(6000 + i, 25)} {shared} {prose(7000 + i, 25)}", "s1") for i in range(30)]
    want = brute_classes(rows)
    got = near.classes(frame(spark, rows).selectExpr("*", "5 as class_id", "'k' as key")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = collections.Counter(want[i] for i, _, _ in rows)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_copies_of_rows_without_id(spark, docs):
    got = near.classes(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    loose = [r for r in got if r.doc_id is None]
    assert sorted(str(r.class_id) for r in loose) == ["100", "None"]
    kept = near.drop_near_copies(frame(spark, docs).selectExpr("*", "1 as `a.b`"))
    assert kept.columns[-1] == "a.b"
    assert kept.filter("text like '%nobody%'").count() == 1
    assert kept.filter("doc_id between 100 and 201").count() == 1


def test_star_rounds_settle_large_buckets(spark):
    words = prose(9, 120).split()
    rows = []
    for i in range(60):
        own = list(words)
        own[(i * 7) % 120] = f"q{i}"
        rows.append((i, " ".join(own), "s0"))
    assert {r.class_id for r in near.classes(frame(spark, rows)).collect()} == {0}


def test_signatures_estimate_weighted_similarity():
    a, b = [f"w{i % 50} x{i % 31}" for i in range(400)], [f"w{i % 50} x{i % 31}" for i in range(300)]
    elems, counts, _ = near.elements([" ".join(a), " ".join(b)])
    x, y = set(elems[:counts[0]].tolist()), set(elems[counts[0]:].tolist())
    sig = near.signatures(elems, counts, 1024)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.06


def test_components_of_a_chain(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert set(got) == {bytes([i]) for i in range(41)} | {b"\xf0", b"\xf1"}
    assert {bytes(v) for k, v in got.items() if bytes(k) < b"\xf0"} == {b"\x00"}


# --- mixing ------------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 20 + i % 300), ["a", "b", "c", None, "hot"][min(i % 9, 4)]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, " \t\n", "b"), (2002, prose(4, 9000), "c"), (None, "no id here", "a")]
    df = frame(spark, rows).selectExpr("*", "1 as size", "2 as taken", "3 as row", "4 as start")
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets, taken, of = brute_targets(sizes), collections.Counter(), {i: s for i, _, s in rows}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) < 0.02 * target + 128
    assert sorted(got, key=str) == sorted(mixing.mix_counts(df.repartition(5)).collect(), key=str)


def test_mixed_documents_hold_the_words_counted(spark):
    rows = [(i, prose(i, 5 + (i * 37) % 400) + "\n", "ab"[i % 2]) for i in range(120)] + [(500, "", "a"), (501, None, "b")]
    rows += [(7, rows[7][1], "b")]  # a repeated row
    df = frame(spark, rows)
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(df).collect()}
    mixed = mixing.mix_documents(df).collect()
    words = collections.Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        whole = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert r.text == whole or set(r.text.split()) <= set(whole.split())
    counts[7] *= 2
    assert {k: v for k, v in counts.items() if v} == dict(words)
    assert mixing.mix_documents(df).columns == df.columns


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutations_are_bijective(size, key):
    image = mixing.permuted(np.arange(size), size, np.full(size, key, np.uint64))
    assert sorted(image.tolist()) == list(range(size))


def test_plan_of_sources_needs_no_workers_of_its_own(spark):
    rows = spark.createDataFrame([("a", 300), ("b", 50), (None, 7)], "source string, size long")
    plan = mixing.plan_sources(rows, rows)
    assert "PythonRDD" not in plan._jdf.queryExecution().toRdd().toDebugString()
    assert [(r.source, r.number, r.source_size) for r in plan.orderBy("number").collect()] == [("a", 0, 300), ("b", 1, 50), (None, 2, 7)]
    none = mixing.plan_sources(rows.limit(0), rows.limit(0))
    assert none.count() == 0 and none.schema == plan.schema


def test_shard_counts_add_up():
    slots = np.array([5000, 1, 0, 17000, 321])
    shards, size = 11, 2048
    ends = np.zeros(5, np.int64)
    for shard in range(shards):
        first, count = mixing.shard_counts(slots, shard, shards, size, 3)
        assert (first == ends).all()
        ends = first + count
        assert count.sum() == min(size, slots.sum() - shard * size)
    assert (ends == slots).all()
    huge = mixing.split_counts(np.array([3 * 10**9, 10**9]), 10**9, (1,))
    assert huge.tolist() == [750_000_000, 250_000_000]


def test_the_quality_space_is_fitted_by_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'good plain words' if i % 2 else 'xx 11 !! zz'} number {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    rows = quality.labelled_rows(docs, labels)
    sample = sorted(rows.collect(), key=lambda r: (r.order, r.labelled))
    want = quality.fit_terms(np.stack([np.frombuffer(r.terms, np.float32) for r in sample]), [r.quality for r in sample])
    monkeypatch.setattr(np.linalg, "eigh", None)  # in the driver only
    got = quality.fit_rows(rows)
    assert np.allclose(got.weights, want.weights) and got.labels.tolist() == want.labels.tolist() and got.prior == want.prior
    assert np.allclose(got.vectors @ got.vectors.T, want.vectors @ want.vectors.T, atol=1e-4) and got.axes.shape == want.axes.shape
    scores = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


# --- SentencePiece -----------------------------------------------------------------------------

EDGES = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁x", "\n", "a\nb", "\t\tx ", "日本 語🙂", "é" * 300, "\u00a0x", "x\r\n  y",
         "</s> <unk> <0x0A>", "a" * 5000, "\x01\x02", "　"]


def expected(text):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    ids = library.encode(text or "")
    return [*ids, library.eos_id()], library.decode(ids)


def test_pieces_equal_the_library(spark, docs):
    rows = [(i, t, "s") for i, t in enumerate(EDGES)] + [(i, t, s) for i, t, s in docs]
    df = frame(spark, rows).selectExpr("*", "1 as IDS", "2 as decoded", "3 as __x")
    got = pieces.encode(df, model_file()).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, back = expected(r.text)
        assert (r.ids, r.decoded) == (ids, back), repr(r.text)[:80]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ▁\n\tü日.<0>")), max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_chunks_join_to_whole_texts(texts):
    table = pieces.shared_table(model_file(), 50)  # a small table starts anew often
    ids, offsets, back = pieces.encode_block(table, texts, 2)
    for i, t in enumerate(texts):
        assert (ids[offsets[i]:offsets[i + 1]].tolist(), back[i]) == expected(t)


# --- personal data -----------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    odd = [int(d) for d in digits[::-1]]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd))
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in span.split(".")),
            "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]


def brute_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m.group())] for k, p in PATTERNS.items()}


@given(st.lists(st.sampled_from(["a", "@", ".", "-", "b.c", "+", "1", "25", "256", "4111 1111 1111 1111", "4111111111111111", " ", "(", ")",
                                 "1.2.3.4", "é", "0", "%", "+1 (555) 010-9999", "x@y.z"]), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("1" * 200_000 + "." + "2" * 200_000)["ip"] == []


def personal(spark):
    rng = random.Random(2)
    texts = []
    for i in range(240):
        card = [rng.randrange(10) for _ in range(15)]
        check = next(d for d in range(10) if pii.luhn("".join(map(str, card)) + str(d)))
        texts.append(f"{prose(i, 30)} mail me.{i}@host{i}.example.com or +1 (555) 010-{i:04d} from 10.0.{i}.7 card "
                     f"{''.join(map(str, card))}{check} version 2.{i}.1 token = {rng.getrandbits(128):032x}")
    return frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), texts


def test_trees_add_spans_and_leave_clean_texts(spark):
    df, texts = personal(spark)
    trees = pii.train(df)
    assert trees is not None and any(t <= 1 for t in trees.thresholds.values())
    for text in texts[:40]:
        chosen = pii.select(text, trees)
        assert {k: [s[1:3] for s in chosen if s[0] == k and s[3]] for k in pii.KINDS} == brute_spans(text)
    added = [s for s in pii.select("please call 1 (555) 010-4242 or write to joe.b at host3.example.com today", trees) if not s[3]]
    assert added
    clean = "Nothing here but 12 words, version 3.14 of 2024 and a hash 9f86d081884c7d659a2feaa0c55ad015."
    assert pii.select(clean, trees) == []


BESIDE = [("pay 4111 1111 1111 1111 12/27 now", "card", "4111 1111 1111 1111"),
          ("call +1 (555) 010-4242 2024-05-01 ok", "phone", "+1 (555) 010-4242"),
          ("cards 4111 1111 1111 1111 5500 0000 0000 0004 end", "card", "4111 1111 1111 1111"),
          ("cards 4111 1111 1111 1111 5500 0000 0000 0004 end", "card", "5500 0000 0000 0004"),
          ("x00004111111111111111000000000000000", "card", "4111111111111111")]


def test_numbers_beside_others_are_candidates():
    for text, kind, span in BESIDE:
        found = [(k, text[a:b]) for k, a, b in pii.candidates(text, pii.base_spans(text))]
        assert (kind, span) in found and len(found) == len(set(pii.candidates(text, pii.base_spans(text))))


def brute_numbers(text):
    groups, found = [m.span() for m in re.finditer("[0-9]+", text)], set()
    for i, (a, b) in enumerate(groups):
        start = a - len(re.search(r"\+?\(?$", text[:a]).group())
        for j in range(i, len(groups)):
            if j > i and not re.fullmatch(r"[ ().\-/_·]{1,2}", text[groups[j - 1][1]:groups[j][0]]):
                break
            n = len(re.sub("[^0-9]", "", text[a:groups[j][1]]))
            found |= {(k, start, groups[j][1]) for k, least, most in (("phone", 7, 15), ("card", 13, 19)) if least <= n <= most}
        found |= {("card", x, y) for x in range(a, b) for y in range(x + 13, min(b, x + 19) + 1)
                  if (x, y) != (a, b) and pii.luhn(text[x:y])}
    return found


@given(st.lists(st.sampled_from(["1", "42", "4111", "5550104", "9" * 17, "41111111111111110", " ", "-", "/", " (", ") ", "+", "+(", "   ", "x", "."]),
                max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_number_candidates_are_all_rows_of_groups(text):
    found = list(pii.numbers(text))
    assert set(found) == brute_numbers(text) and len(found) == len(set(found))


def test_trees_choose_numbers_beside_others(spark):
    trees = pii.train(personal(spark)[0])
    for text, kind, span in BESIDE[:4]:
        assert (kind, span) in [(s[0], text[s[1]:s[2]]) for s in pii.select(text, trees)], text


LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\bat\b)\s?[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?[A-Za-z0-9-]{1,63}){1,6}", re.I)


@given(st.lists(st.sampled_from(["joe", "a.b", " ", "at", "AT", "@", "(at)", "[at]", " at ", ".", "dot", " (dot) ", "host.example", "com", "-", "é",
                                 "\n", "x" * 64]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_loose_emails_hold_all_matches_of_the_pattern(text):
    found = set(pii.loose_emails(text))
    # A match of the whole pattern may run over another's at sign; from each name at the latest at sign it is found.
    assert all(any(s <= m.end() and m.start() <= e for s, e in found) for m in LOOSE_EMAIL.finditer(text))
    assert all(LOOSE_EMAIL.match(text, s) for s, e in found)


def test_worded_emails_are_candidates_whatever_else_the_text_holds():
    for text in ("write to joe.b at host3.example.com today", "please call 1 (555) 010-4242 or write to joe.b at host3.example.com today"):
        assert "joe.b at host3.example.com" in [text[a:b] for k, a, b in pii.candidates(text, pii.base_spans(text)) if k == "email"]


def test_worded_emails_are_found_whatever_else_the_text_holds(spark):
    trees = pii.train(personal(spark)[0])
    for text in ("write to joe.b at host3.example.com today", "please call 1 (555) 010-4242 or write to joe.b at host3.example.com today"):
        assert "joe.b at host3.example.com" in [text[a:b] for k, a, b in pii.candidates(text, pii.base_spans(text)) if k == "email"]
        assert ("email", "joe.b at host3.example.com", False) in [(s[0], text[s[1]:s[2]], s[3]) for s in pii.select(text, trees)]


def test_number_tables_switch_no_rare_kind_off(spark):
    rng = random.Random(3)
    texts = personal(spark)[1][:80] + [" ".join(f"{rng.randrange(10 ** 7, 10 ** 9)};" for _ in range(4000)) for _ in range(8)]
    trees = pii.train(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), sample_candidates=800)
    assert all(t <= 1 for t in trees.thresholds.values()), trees.thresholds


def test_thresholds_count_all_candidates():
    assert pii.threshold([(4000, 1.0, 99), (3000, 0.0, 1), (2500, 0.0, 5)], 0.99) == 2501 / 4096
    assert pii.threshold([(4000, 1.0, 9)], 0.99) == 2.0 and pii.threshold([(4000, 1.0, 10)], 0.99) == 0.5


def test_find_and_redact(spark):
    df = frame(spark, [(1, "x joe@a.example.com y", "s"), (2, None, "s"), (3, "", "s")]).selectExpr("*", "1 as SPANS")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in got[1]] == [("email", 2, 19, True)] and not got[2] and not got[3]
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "x <email> y", 2: None, 3: ""}
    assert pii.train(df) is None


# --- quality -----------------------------------------------------------------------------------

def test_quality_of_held_out_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = prose(i, 40 + rng.randrange(200))
        if not good:
            text = "|".join(w + "!!" for w in text.upper().split()) if i % 2 else " ".join([text.split()[0]] * 60)
        rows.append((i, text, "s"))
        labels.append((i, int(good)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, " ", "s"), (None, "no id", "s"), (1, rows[1][1], "s")]
    labels += [(1, None), (None, 1), (5000, 1), (7, 9)]
    df = frame(spark, rows).selectExpr("*", "'x' as score", "0 as Held_Out")
    got = quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(labels[:600])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held) > 100
    assert len({r.score for r in got if not r.text}) == 1
    one = [r.score for r in got if r.doc_id == 1]
    assert one[0] == one[1]


def test_votes_are_exact_cosines():
    sample = [(prose(i, 30), i % 2) for i in range(60)]
    space = quality.fit(sample, 16)
    latent = space.latent(quality.terms([prose(500 + i, 30) for i in range(9)]))
    for v, s in zip(latent, space.vote(latent, 7)):
        near_ = sorted(range(60), key=lambda j: -float(space.vectors[j] @ v))[:7]
        w = np.array([max(0.0, float(space.vectors[j] @ v)) ** 2 for j in near_])
        assert s == pytest.approx(float((w * space.labels[near_]).sum() / w.sum()), abs=1e-5)


# --- empty tables --------------------------------------------------------------------------------

def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    for out in (exact.mark_copies(none), near.classes(none), near.drop_near_copies(none), mixing.mix_counts(none),
                mixing.mix_documents(none), pieces.encode(none, model_file()), pii.find(none, trees=pii.train(none)),
                quality.score(none, labels)):
        assert out.collect() == []
    some = frame(spark, [(1, "text", "s")])
    assert quality.score(some, labels).collect()[0].score == 0.5
