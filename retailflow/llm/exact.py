"""Exact dedup: two Bloom passes find the hashes that may repeat; only their rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.llm import bloom
from retailflow.llm.common import columns, salted_totals, salts, unused, whole_text, without


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                most_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical; null counts as empty and equals it. Of equal texts the row
    with the largest id stays, a null id counting as the smallest. Of repeated rows with that
    very id one stays, and it doesn't matter which. Input columns named like the results are
    replaced, all others pass through. An empty table gives an empty result.

    The first pass fills a filter with the hashes that may occur twice, the second tests each row
    against it. Rows whose hash surely occurs once skip the shuffle. The others meet by (digest, salt), the
    salt coming from the id, so that a text of which there are millions of copies is spread over
    about the root of the number of rows.
    """
    docs = without(docs, "text_sha256", "keep_id", "group_size", "kept")
    own_hash, salt, repeat = unused(docs, "hash", "salt", "repeat")
    rows = docs.count()
    hashed = docs.withColumn(own_hash, F.xxhash64(whole_text(text)))
    bits = bloom.build(hashed, own_hash, rows, times=2, most_bytes=most_bytes)  # first pass
    marked = (docs.withColumn("text_sha256", F.sha2(whole_text(text).cast("binary"), 256))
              .withColumn(own_hash, F.xxhash64(whole_text(text))))
    marked = marked.withColumn(repeat, bloom.test(docs.sparkSession, F.col(own_hash), bits)).drop(own_hash)

    single = (marked.filter(~F.col(repeat)).drop(repeat)
              .withColumn("keep_id", F.col(doc_id)).withColumn("group_size", F.lit(1).cast("long"))
              .withColumn("kept", F.lit(True)))
    again = (marked.filter(repeat).drop(repeat)
             .withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(salts(rows)))))
    totals = salted_totals(again, "text_sha256", doc_id, salt,
                           ("keep_id", F.max(doc_id), F.max("keep_id")),
                           ("group_size", F.count(F.lit(1)), F.sum("group_size")))
    # Equal ids share a salt, so the copies of one row are numbered within a cell.
    same_row = Window.partitionBy("text_sha256", salt, doc_id).orderBy(F.lit(1))
    joined = (again.join(totals, ["text_sha256", salt])
              .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")) & (F.row_number().over(same_row) == 1)))
    results = columns(docs, "text_sha256", "keep_id", "group_size", "kept")
    return single.select(*results).unionByName(joined.select(*results))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the copies that :func:`mark_copies` rejects."""
    marked = mark_copies(docs, **options).filter("kept")
    return without(marked, "text_sha256", "keep_id", "group_size", "kept")
