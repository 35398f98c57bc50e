"""WARC, URL, vector and token-file operators, and the pipeline."""

import gzip
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailflow.llm import counts, topk, urls, warc
from retailflow.llm.queries import model_file

import corpus_pipeline

PAGES = "page_id long, url string, html string"


# --- WARC --------------------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>\r\nWARC/1.1\r\n" * 200
    rows = [(i, f"http://h/{i}", big) for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "http://a\r\nb", "x" * 999), (53, "http://c", "x" * 999), (54, "u", "y" * 1000),
             (None, "n", big), (None, "m", "z" * 2000), (60, "v", "ü" * 500), (61, "w", "ü" * 500), (62, "big", "q" * 3_000_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as RECORD_TYPE", "2 as refers_to", "3 as payload").repartition(3)
    got = warc.archived_pages(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert all(by[i].record_type == "revisit" and by[i].refers_to == 39 for i in range(39))
    assert by[39].record_type == "response" and by[39].payload_bytes == len(big.encode())
    assert [by[i].record_type for i in (50, 51, 52, 53, 54, 60, 61)] == ["response"] * 5 + ["revisit", "response"]
    assert by[60].refers_to == 61 and by[60].payload_bytes == 1000 and by[60].payload_digest == by[61].payload_digest
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 39)]
    whole = warc.read_warc(spark, str(tmp_path / "w"))
    assert {r.page_id: bytes(r.payload) for r in whole.filter("page_id in (39, 51, 62)").collect()} == {
        39: big.encode(), 51: b"", 62: b"q" * 3_000_000}


def test_header_filters_are_pushed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}/{i}", "x" * 1500) for i in range(10)], PAGES)
    warc.write_warc(warc.mark_revisits(df), str(tmp_path / "w"))
    found = warc.read_warc(spark, str(tmp_path / "w")).filter(
        (F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r.page_id for r in found.collect()) == [0, 2, 4, 6, 8]
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_type",), ("revisit", "x")),
                                    StringStartsWith(("target_uri",), "http://a/"), EqualTo(("payload_bytes",), 3)]))
    assert left == [EqualTo(("payload_bytes",), 3)]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 5


def test_gzip_and_cut_off_records(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert [bytes(r.payload) for r in got] == [b"hello"] * 2 and got[0].page_id is None
    (tmp_path / "w" / "b.warc").write_bytes(record[:-8])
    with pytest.raises(Exception, match="ends before its length"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()


# --- URLs ----------------------------------------------------------------------------------------

URLS = ["http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/1?q=/", "http://x.net/es/1", "http://net/fr/",
        "http://x.net/de/", "http://example.org/es/", "//example.com/en/", "", None, "ftp://com", "http://com/", "http://notcom/", "http://a.com/EN/",
        "http://example.com/en", "http://example.com/en/?http://x.net/es/", "http://user@x.net:80/fr/", "a://b://c.net/es/", "http://.com/",
        "http://x.net#/es/", "http://ÄX.net/fr/é"]


def brute_verdict(url, rules=urls.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_verdicts(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(0, URLS[0], ""), (None, URLS[3], "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as HOST", "2 as rule", "3 as `k.k`")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url), r.url


def test_a_long_list(spark):
    rng = random.Random(1)
    rules = [(f"h{rng.randrange(300)}.example.org", f"/{rng.randrange(5)}" * rng.randrange(1, 3), "block") for _ in range(2000)]
    pages = [(i, f"http://w{i % 3}.h{rng.randrange(400)}.example.org/{rng.randrange(9)}/{rng.randrange(9)}", "") for i in range(800)]
    got = urls.judge(spark.createDataFrame(pages, PAGES), urls.rule_list(spark, rules + [(None, "/", "block"), ("a.b", None, "block")])).collect()
    assert all((r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url, rules) for r in got)
    empty = urls.judge(spark.createDataFrame(pages[:5], PAGES), urls.rule_list(spark, rules).limit(0))
    assert {r.verdict for r in empty.collect()} == {"allow"}


# --- vectors -------------------------------------------------------------------------------------

def brute_top(rows, k):
    whole = {i: np.floor(64 * np.array(v, float)) for i, v in rows if i is not None and v is not None
             and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:k]
        out |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("levels", [3, 60])
def test_top_k_against_all_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [(i, (rng.integers(-levels, levels, 12) / 40).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(800, 840)] + [(900, None), (920, [1.0, None]), (940, [float("nan")] * 12), (960, [0.5, 0.25]),
                                                         (961, [1.0, 1.0]), (980, []), (None, rows[0][1]), (1000, [0.0] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as vec", "2 as rank")
    vectors = topk.integer_vectors(df)
    got = topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, candidates_per_task=150, queries_per_task=16)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 20)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-30, 30, (200, 9)).astype(float), rng.integers(-30, 30, (40, 9)).astype(float).T
    lists, score = topk.SortedLists(x), x @ q
    for share in (0.01, 0.3, 0.7, 1.0):
        lower, upper = lists.bounds(share, np.maximum(q, 0), np.minimum(q, 0))
        assert (lower <= score + 1e-9).all() and (score <= upper + 1e-9).all()


def test_few_and_no_vectors(spark):
    def top(rows):
        v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        return topk.top_k(v, v.filter("vec_id % 20 = 0")).collect()
    assert top([]) == [] and top([(0, [1.0])]) == []
    assert [tuple(r) for r in top([(0, [1.0]), (1, [-1.0]), (2, [1.0])])] == [(0, 1, 2, 4096), (0, 2, 1, -4096)]


# --- token files -----------------------------------------------------------------------------------

def test_token_files(spark, tmp_path):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    rows = [(i * 7 - 3, "word " * (i % 11) + "é\n", 1) for i in range(300)]
    rows += [(2**62, None, 1), (-2**63, "", 1), (2**63 - 1, "long text " * 4000, 1), (None, "no id", 1), (5, "twice", 1), (5, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    counts.write_tokens(df, str(tmp_path / "t"), model_file())
    want = sorted((str(i), len(library.encode(t or "")) + 1) for i, t, _ in rows)
    for block in (1 << 20, 1000, 7, 3):  # blocks shorter than documents and than their id words
        got = counts.count_tokens(spark, str(tmp_path / "t"), library.eos_id(), block).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
        assert len({(r.file, r.document) for r in got}) == len(rows)
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("part-*"))
    assert size == 2 * (sum(n for _, n in want) + 5 * (len(rows) - 1))


def test_unended_and_empty_token_files(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    np.array([5, 6, 2, 7], ">u2").tofile(folder / "a.bin")
    (folder / "b.bin").touch()
    got = counts.count_tokens(spark, str(folder), 2, 2).orderBy("document").collect()
    assert [(r.document, r.doc_id, r.n_tokens) for r in got] == [(0, None, 3), (1, None, 1)]
    assert counts.document_tokens(spark.createDataFrame([], "doc_id long, text string"), model_file(), str(tmp_path / "e")).collect() == []


# --- pipeline ----------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, before = docs, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, folder)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert kept.columns == docs.columns
        if n < 3:
            assert kept.subtract(before).isEmpty() and kept.count() <= before.count()
    assert kept.count() == before.count() == corpus_pipeline.run(spark, folder).count()


def test_long_hosts_and_lists_of_many_lengths(spark):
    """A host of 20,000 labels gets its verdict, and the lengths of one host's rules say nothing about another's."""
    long_host = ".".join(["a"] * 20_000)
    listed = [("com", "/", "allow"), ("a.net", "/x", "block")] + [("many.org", "/" + "p" * n, "block" if n % 2 else "allow") for n in range(10_000)]
    rules = spark.createDataFrame(listed, "rule_host string, rule_path string, verdict string")
    pages = [(1, f"http://{long_host}.net/x"), (2, f"http://{long_host}.com/" + "q" * 50_000), (3, "http://many.org/" + "p" * 9_000 + "z"),
             (4, "http://www.many.org/pp"), (5, "http://other.org/ppp"), (6, f"http://{long_host}.org/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {1: ("a.net/x", "block"), 2: ("com/", "allow"), 3: ("many.org/" + "p" * 9_000, "allow"), 4: ("many.org/pp", "allow"),
                   5: (None, "allow"), 6: (None, "allow")}


def test_a_small_filter_gives_the_same_verdicts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/p{i}") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([(f"h{i}.example.com", f"/p{i}", "block") for i in range(40)], "rule_host string, rule_path string, verdict string")

    def verdicts(**options):
        return sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules, **options).collect())
    assert verdicts(most_bytes=1) == verdicts() and sum(v == "block" for _, _, v in verdicts()) > 40
