"""Traffic bands, category types, search and filter hits against the product catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import CATEGORY_DEFAULT_TYPE, CATEGORY_KEYWORDS, NORMAL_HOURS, PEAK_HOURS, PRICE_BANDS
from retailflow.functions.labels import first_match

#: Leading characters by which queries are summarised.
HEAD = 3


def traffic_band(ts: Column) -> Column:
    hour = F.hour(ts)
    return (F.when(hour.isin(*PEAK_HOURS), "peak").when(hour.isin(*NORMAL_HOURS), "normal").otherwise("low"))


def traffic_bands(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    return events.groupBy(traffic_band(F.col(ts)).alias("band")).agg(F.count(F.lit(1)).alias("events"))


def category_type(category: Column, rules=CATEGORY_KEYWORDS, default: str = CATEGORY_DEFAULT_TYPE) -> Column:
    text = F.lower(category)
    return first_match([(reduce(Column.__or__, [text.contains(w) for w in words]), name) for name, words in rules],
                       default)


def category_types(products: DataFrame, rules=CATEGORY_KEYWORDS, default: str = CATEGORY_DEFAULT_TYPE) -> DataFrame:
    return (products.groupBy("category").agg(F.count(F.lit(1)).alias("products"))
            .withColumn("category_type", category_type(F.col("category"), rules, default)))


def _positions(text: Column) -> Column:
    """Every start position with the substrings of 1..HEAD characters that begin there."""
    def heads(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length(text) - at + 1)),
                           lambda size: F.struct(at.alias("at"), F.substring(text, at, size).alias("head"),
                                                 text.alias("text")))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    return F.coalesce(F.flatten(F.transform(starts, heads)),
                      F.array().cast("array<struct<at:int,head:string,text:string>>"))


def search_hits(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products whose name or category contains the query, ignoring case; blank queries are no search.

    No query is compared with a product. Queries are summarised by their first characters
    and the lengths that occur after them; at each position of a catalog text those lengths
    cut out the substrings some query could equal, and counting products per substring
    leaves an equality join. Fan-out is bounded by query lengths, not by query count.
    """
    wanted = queries.select(F.lower("search_query").alias("q")).filter(F.col("q") != "").distinct()
    lengths = (wanted.groupBy(F.substring("q", 1, HEAD).alias("head"))
               .agg(F.collect_set(F.length("q")).alias("sizes")))
    texts = (catalog.groupBy(F.lower("name").alias("name"), F.lower("category").alias("category"))
             .agg(F.count(F.lit(1)).alias("products")))
    places = texts.select("*", F.explode(F.concat(_positions(F.col("name")), _positions(F.col("category")))).alias("p"))
    cut = (places.join(lengths, places["p.head"] == lengths["head"])
           .select("name", "category", "products", "p.at", "p.text", F.explode("sizes").alias("size"))
           .filter(F.col("at") + F.col("size") - 1 <= F.length("text"))
           .withColumn("q", F.substring(F.col("text"), F.col("at"), F.col("size"))))
    # Few of the substrings are wanted; the others leave before anything is gathered.
    found = (cut.join(wanted, "q", "left_semi").select("name", "category", "products", "q").distinct()
             .groupBy("q").agg(F.sum("products").alias("results")))
    return (wanted.join(found, "q", "left")
            .select(F.col("q").alias("search_query"),
                    F.coalesce("results", F.lit(0).cast("bigint")).alias("results_count")))


def filter_hits(catalog: DataFrame, bands=PRICE_BANDS) -> DataFrame:
    """Products per category filter, price-band filter and both; band ends are inclusive.

    A price on a shared edge belongs to both bands, so each product carries the list of its bands.
    """
    inside = F.filter(
        F.array(*[F.struct(F.lit(float(lo)).alias("min_price"), F.lit(float(hi)).alias("max_price"))
                  for lo, hi in bands]),
        lambda b: F.col("price").between(b["min_price"], b["max_price"]))
    by_category = (catalog.groupBy("category").agg(F.count(F.lit(1)).alias("results_count"))
                   .select(F.col("category").alias("filter_category"),
                           F.lit(None).cast("double").alias("min_price"),
                           F.lit(None).cast("double").alias("max_price"), "results_count"))
    both = (catalog.select("category", F.explode(inside).alias("b"))
            .groupBy(F.col("category").alias("filter_category"), "b.min_price", "b.max_price")
            .agg(F.count(F.lit(1)).alias("results_count")))
    by_band = (both.groupBy("min_price", "max_price").agg(F.sum("results_count").alias("results_count"))
               .withColumn("filter_category", F.lit(None).cast("string")))
    return by_category.unionByName(both).unionByName(by_band)
