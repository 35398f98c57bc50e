"""Registered queries of the operators and the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm import counts, exact, mixing, near, negatives, pieces, pii, quality, spelling, topk, urls, warc, wrappers

#: Vocabulary of the SentencePiece queries, a file of the installed package of public tokenizers.
PIECES = "piece_bpe_32k.model"


def model_file(name: str = PIECES) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, model_file())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, trees=pii.train(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.filter(base, lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *(F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.document_tokens(docs, model_file()).select("doc_id", "n_tokens")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.classes(docs).select("doc_id", "class_id", "class_size", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = negatives.integer_rows(table(spark, sf_dir, "embeddings"), moved)
    return negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {q.__name__: q for q in (op1_quality, op2_exact_dedup, op3_top_k, op4_warc, op5_mixing, op6_sentencepiece,
                                   op7_pii, op8_urls, op9_token_counts, op10_near_dedup, op11_hard_negatives,
                                   op12_spelling, op13_html, pipeline)}

SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM m""",
    "op8_urls": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id,
                     coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        f AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS verdict
              FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.vec, c.vec)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
                AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_spelling": r"""
        WITH RECURSIVE r AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        g AS (SELECT doc_id, run, hex(encode(doc_id || ':' || run)) AS bytes, count(*) AS n FROM r
              WHERE length(run) >= 6 GROUP BY doc_id, run),
        h AS (SELECT run, n, xor(4294967295, list_reduce(
                  list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1:2 * i + 2])::BIGINT),
                  lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)),
                  4294967295::BIGINT)) AS h FROM g),
        w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word,
                     n FROM h),
        c AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        d AS (SELECT word, n, pos, word[1:pos - 1] || word[pos + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS pos FROM c)),
        near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
                 UNION SELECT a.word, c.word, c.n FROM d a JOIN c ON a.rest = c.word
                 UNION SELECT c.word, a.word, a.n FROM d a JOIN c ON a.rest = c.word),
        b AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM near GROUP BY word),
        f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near,
                     CASE WHEN best_n >= 5 * c.n THEN (SELECT min(encode(other))::BLOB FROM near x WHERE x.word = c.word AND x.n = best_n) END AS form,
                     CASE WHEN best_n >= 5 * c.n THEN best_n END AS form_n FROM c LEFT JOIN b USING (word)),
        t AS (SELECT word, decode(form) AS form, n, n_near, form_n FROM f),
        walk AS (SELECT word, word AS root FROM t UNION ALL SELECT walk.word, t.form FROM walk JOIN t ON walk.root = t.word AND t.form IS NOT NULL),
        ends AS (SELECT walk.word, root FROM walk JOIN t ON walk.root = t.word WHERE t.form IS NULL)
        SELECT t.word, form, root, n, n_near, form_n FROM t JOIN ends USING (word)""",
    # The pages of the given tables have one template and two references in it; the operator knows neither.
    "op13_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'),
                     '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS plain FROM a),
        b AS (SELECT page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS text FROM t)
        SELECT page_id, url, text, length(text) AS n_chars FROM b""",
}
