"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm import bloom
from retailflow.llm.common import columns, unused, without

#: Parts over which URLs of one listed host are spread; the list is copied so many times.
SALTS = 16

#: (host, path, verdict) of the production list.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    host, path = host_and_path(F.col(url))
    return pages.withColumn("host", host).withColumn("path", path)


def rule_list(spark: SparkSession, rules=RULES) -> DataFrame:
    """The list as a table (rule_host, rule_path, verdict)."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def canonical(rules: DataFrame) -> DataFrame:
    """One row per host and path: hosts in lower case without outer dots, null parts empty, ``rule``
    the text of both. Of repeated entries with differing verdicts ``block`` stays."""
    host = F.trim(F.translate(F.coalesce("rule_host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return (rules.select(F.regexp_replace(host, r"^\.+|\.+$", "").alias("rule_host"),
                         F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict")
            .filter("rule_host != ''").groupBy("rule_host", "rule_path")
            .agg(F.max("verdict").alias("rule_verdict"))
            .withColumn("rule", F.concat("rule_host", "rule_path")))


def host_suffixes(host: Column, label_counts: list[int]) -> Column:
    """The ends of a host of those numbers of labels that the list has; nothing else of a long host is built."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    fitting = F.filter(F.array(*[F.lit(x) for x in label_counts or [0]]), lambda c: c <= n)
    return F.transform(fitting, lambda c: F.array_join(F.slice(labels, n - c + 1, c), "."))


def possible_in(spark: SparkSession, bits: bytes):
    """A test of an array of hashes against a filter."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("array<boolean>")
    def possible(hashes: pa.Array) -> pa.Array:
        flat = bloom.contains(shared.value, hashes.flatten().to_numpy(zero_copy_only=False))
        sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    # Not deterministic to the optimizer, which would else move the call into a lambda.
    return possible.asNondeterministic()


def passing(df: DataFrame, name: str, values: Column, hashed, possible) -> DataFrame:
    """``df`` with ``name``: those of an array's values whose hash may be in the filter."""
    (flags,) = unused(df, "flags")
    df = df.withColumn(name, values)
    df = df.withColumn(flags, possible(F.transform(F.col(name), hashed)))
    kept = F.filter(F.transform(F.arrays_zip(F.col(name).alias("v"), F.col(flags).alias("p")), lambda z: F.when(z["p"], z["v"])),
                    lambda v: v.isNotNull())
    return df.withColumn(name, kept).drop(flags)


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", otherwise: str = "allow",
          most_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule
    text wins, of equally long ones that with the longer host; without a rule the verdict is
    ``otherwise`` (an unlisted URL) and ``rule`` null. Null URLs and those without ``://`` fit no rule.
    Input columns named like the results are replaced, all others pass through.

    The ends of each host are tested in a filter of the listed hosts; URLs without a possible hit, and those whose
    path starts with no listed one by a second filter, pass straight through. Path prefixes are made of the lengths
    that the hit host itself has, whatever the rest of the list has. Possible hits join the list exactly, one row for each
    distinct pair of host and path, spread over salts. Filters hold ``most_bytes`` each at most; on longer lists they
    let more URLs through to the join, never fewer.
    """
    spark = pages.sparkSession
    listed = canonical(rules if rules is not None else rule_list(spark))
    pages = with_parts(without(pages, "host", "path", "rule", "verdict"), url)
    names = columns(pages)
    rows = listed.count()
    hosts = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    counts = [r.n for r in listed.select(F.size(F.split("rule_host", r"\.", -1)).alias("n")).distinct().collect()]  # a few numbers
    host_filter = possible_in(spark, bloom.build(hosts.select(F.xxhash64("rule_host").alias("h")), "h", rows, most_bytes=most_bytes))
    key_filter = possible_in(spark, bloom.build(listed.select(F.xxhash64("rule_host", "rule_path").alias("h")), "h", rows,
                                                most_bytes=most_bytes))

    (ends,) = unused(pages, "ends")
    keyed = passing(pages, ends, host_suffixes(F.col("host"), counts), lambda h: F.xxhash64(h), host_filter)
    clear = keyed.filter(F.size(ends) == 0).select(*names, F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    hit = keyed.filter(F.size(ends) > 0)

    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    asked = (hit.select("host", "path", F.col(ends).alias("ends")).dropDuplicates(["host", "path"]).withColumn("salt", salt)
             .select("host", "path", "salt", F.explode("ends").alias("end")))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    lengths = hosts.select("rule_host", "lengths", copies.alias("part"))
    fitting = asked.join(lengths, (F.col("end") == F.col("rule_host")) & (F.col("salt") == F.col("part"))).select(
        "host", "path", "salt", "end", F.filter("lengths", lambda n: n <= F.length("path")).alias("lengths"))
    tried = passing(fitting, "prefixes", F.transform("lengths", lambda n: F.substring(F.col("path"), F.lit(1), n)),
                    lambda p: F.xxhash64(F.col("end"), p), key_filter).select("host", "path", "salt", "end", F.explode("prefixes").alias("start"))
    found = tried.join(listed.withColumn("part", copies), (F.col("end") == F.col("rule_host")) & (F.col("start") == F.col("rule_path"))
                       & (F.col("salt") == F.col("part")))
    best = found.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(
        F.max(F.struct(F.length("rule"), F.length("rule_host"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("b"))
    of_host, of_path, named, verdict = unused(hit, "of_host", "of_path", "rule", "verdict")
    best = best.select(F.col("of_host").alias(of_host), F.col("of_path").alias(of_path), F.col("b.rule").alias(named), F.col("b.verdict").alias(verdict))
    judged = hit.join(best, (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left").select(
        *names, F.col(named).alias("rule"), F.coalesce(F.col(verdict), F.lit(otherwise)).alias("verdict"))
    return clear.unionByName(judged)
