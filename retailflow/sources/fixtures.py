"""Retail events read from the provided order, part, customer and click tables.

Everything is derived lazily from the files under one scale-factor folder; joins use the
numeric keys and the text ids are built afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailflow.functions.labels import content_id
from retailflow.functions.money import from_cents, line_cents
from retailflow.session import configure
from retailflow.sources.streams import file_stream
from retailflow.sources.tables import bytes_of, is_folder, table_path

#: fixed values: attributes of the regions that stand for countries; one region has none
REGION_ROWS = (
    ("AFRICA", "Sub-Saharan Africa", "Africa", "ZAR", "Africa/Johannesburg"),
    ("AMERICA", "North America", "Americas", "USD", "America/New_York"),
    ("ASIA", "East Asia", "Asia", "JPY", "Asia/Tokyo"),
    ("EUROPE", "Western Europe", "Europe", "EUR", "Europe/Berlin"),
)

#: The tables that grow with the business.
TABLES = ("customer", "part", "orders", "lineitem", "events")


def _id(prefix: str, number: Column, width: int = 8) -> Column:
    """Zero-padded id; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def _order_ids() -> tuple[Column, Column]:
    """Ids of an order and its customer as text."""
    return F.col("o_orderkey").cast("string").alias("transaction_id"), _id("USER_", F.col("o_custkey")).alias("user_id")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


#: Adds columns to rows, none of which it drops or doubles.
Keyed = Callable[[DataFrame], DataFrame]


def _keyed(rows: DataFrame, keyed: Keyed | None) -> tuple[DataFrame, list[str]]:
    """Rows after ``keyed``, and the names of the columns it added."""
    out = keyed(rows) if keyed else rows
    return out, [c for c in out.columns if c not in rows.columns]


class RetailTables:
    """Views of one folder; tables named in ``streaming`` are read as file streams."""

    def __init__(self, spark: SparkSession, folder: str, streaming: frozenset[str] = frozenset()):
        self.input_bytes = sum(bytes_of(spark, table_path(spark, folder, name)) for name in TABLES)
        self.spark = configure(spark, self.input_bytes)
        self.folder = folder
        self.streaming = streaming
        self._schemas: dict[str, StructType] = {}

    def raw(self, name: str) -> DataFrame:
        path = table_path(self.spark, self.folder, name)
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        schema = self._schemas[name]
        if name not in self.streaming:
            return self.spark.read.schema(schema).parquet(path)
        if is_folder(self.spark, path):
            return file_stream(self.spark, path, schema)
        # A file stream reads folders; a table held in one file is picked out by its name.
        return file_stream(self.spark, self.folder, schema, pathGlobFilter=f"{name}.parquet")

    def users(self) -> DataFrame:
        return (self.raw("customer")
                .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("country")))

    def products(self) -> DataFrame:
        return self.raw("part").select(
            _id("PROD_", F.col("p_partkey")).alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))

    def _orders(self, users: Keyed | None = None) -> tuple[DataFrame, list[str]]:
        """Orders with numbers as keys, and the names of the columns that ``users`` added to their customers."""
        ts = F.expr("o_orderdate + interval '1' minute * cast(o_orderkey % 1440 as int)")
        buyers, more = _keyed(self.users().select("c_custkey", _id("USER_", F.col("c_custkey")).alias("user_id"), "country"), users)
        return (self.raw("orders").join(buyers.drop("user_id"), F.col("o_custkey") == F.col("c_custkey"))
                .select("o_orderkey", "o_custkey", ts.cast("timestamp").alias("timestamp"),
                        F.col("o_totalprice").alias("total_amount"),
                        F.col("o_orderpriority").alias("payment_method"), "country", *more)), more

    def transactions(self) -> DataFrame:
        return self._orders()[0].select(*_order_ids(), "timestamp", "total_amount", "payment_method", "country")

    def order_lines(self, users: Keyed | None = None, parts: Keyed | None = None) -> DataFrame:
        """One row per purchased product; ``total_amount`` is the order's.

        Lines meet the parts, then the orders, by number, and text ids are made last, so no line carries them through a shuffle.
        ``users`` (which have ``user_id`` and ``country``) and ``parts`` (``product_id``) are given columns, such as surrogates,
        by these functions before the lines meet them; such columns come last.
        """
        part, of_parts = _keyed(self.raw("part").select(
            "p_partkey", _id("PROD_", F.col("p_partkey")).alias("product_id"), "p_type", "p_retailprice"), parts)
        orders, of_users = self._orders(users)
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                            F.col("l_quantity").cast("int").alias("quantity"))
        return (lines.join(part.drop("product_id"), F.col("l_partkey") == F.col("p_partkey"))
                .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(*_order_ids(), "timestamp", "total_amount", "payment_method", "country",
                        _id("PROD_", F.col("p_partkey")).alias("product_id"),
                        F.col("p_type").alias("category"), "quantity",
                        F.col("p_retailprice").alias("unit_price"),
                        "l_linenumber", "l_suppkey", *of_users, *of_parts))

    def sale_lines(self) -> DataFrame:
        """Stored sale lines: line totals, and ids from the content of the line."""
        return self.stored(self.order_lines())

    @staticmethod
    def stored(lines: DataFrame, *others: str) -> DataFrame:
        """Order lines as they are stored, with ``others`` of their columns. The ids are long: made after joins, they aren't shuffled."""
        return lines.select(
            "transaction_id",
            content_id("transaction_id", "l_linenumber", "product_id", "l_suppkey", "quantity").alias("line_item_id"),
            "user_id", "product_id", "category", "quantity", "unit_price",
            from_cents(line_cents("quantity", "unit_price")).alias("total_amount"),
            F.lit(0.0).alias("discount_amount"), "payment_method", "country",
            F.col("timestamp").alias("transaction_timestamp"), *others)

    def clicks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        user = _id("USER_", F.col("user_id"))
        return (self.raw("events").join(self.users(), F.col("user_id") == F.col("c_custkey"))
                .select(_id("EVT_", F.col("event_id"), 10).alias("event_id"),
                        F.col("ts").cast("timestamp").alias("timestamp"), user.alias("user_id"),
                        F.concat(user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
                        k.alias("k"), F.col("event_type").alias("raw_type"), "value", "country"))

    def view_events(self) -> DataFrame:
        return self._views().drop("k")

    def _views(self) -> DataFrame:
        raw = F.col("raw_type")
        part = self.raw("part").select("p_partkey", "p_name", "p_type", "p_retailprice")
        kind = (F.when(raw == "view", "view").when(raw == "click", "search").when(raw == "signup", "filter")
                .otherwise("compare"))

        def viewed(c: Column) -> Column:
            return F.when(raw == "view", c)
        return (self.clicks().filter(raw.isin("view", "click", "signup", "error"))
                .join(part, F.col("k") == F.col("p_partkey"))
                .select("event_id", kind.alias("event_type"), "timestamp", "user_id", "session_id",
                        viewed(_id("PROD_", F.col("p_partkey"))).alias("product_id"),
                        viewed(F.col("p_name")).alias("product_name"),
                        viewed(F.col("p_type")).alias("category"),
                        viewed(F.col("p_retailprice")).alias("price"),
                        viewed(F.col("k") + 5).alias("view_duration"),
                        F.when(raw == "click", F.concat(F.lit("term"), (F.col("k") % 16).cast("string")))
                        .alias("search_query"),
                        F.when(raw.isin("click", "signup"), F.col("k")).alias("results_count"), "country", "k"))

    def _carts(self) -> DataFrame:
        raw = F.col("raw_type")
        kind = (F.when(raw == "click", "add_to_cart").when(raw == "error", "remove_from_cart")
                .when(raw == "signup", "update_quantity").otherwise("checkout"))
        return (self.clicks().filter(raw.isin("click", "error", "signup", "purchase"))
                .select("event_id", kind.alias("event_type"), "timestamp", "user_id", "session_id",
                        F.when(raw != "purchase", _id("PROD_", F.col("k"))).alias("product_id"),
                        F.when(raw.isin("click", "error"), F.col("k") % 3 + 1).alias("quantity"),
                        F.col("value").alias("cart_value"), "country", "k"))

    def cart_events(self) -> DataFrame:
        return self._carts().drop("k")

    def searches(self) -> DataFrame:
        """Search texts made of catalog words, shortened category names and unknown terms."""
        part = self.raw("part").select("p_partkey", "p_name", "p_type")
        k = F.col("k")
        text = (F.when(k % 3 == 0, F.element_at(F.split("p_name", " "), -1))
                .when(k % 3 == 1, F.substring("p_type", 1, 2))
                .otherwise(F.concat(F.lit("term"), k.cast("string"))))
        return (self.clicks().filter(F.col("raw_type") == "click").join(part, k == F.col("p_partkey"))
                .select("event_id", text.alias("search_query")))

    # --- messages -----------------------------------------------------------------------

    def cart_messages(self) -> DataFrame:
        """JSON text of the cart events; those with k = 13 are cut short, with k = 17 the value is quoted."""
        carts = self._carts().withColumn("timestamp", _iso(F.col("timestamp")))
        body = F.to_json(F.struct(*[c for c in carts.columns if c != "k"]))
        body = F.when(F.col("k") == 17, F.regexp_replace(body, '"cart_value":([^,]+),', '"cart_value":"$1",')).otherwise(body)
        return carts.select(F.when(F.col("k") == 13, F.concat(F.lit("{"), F.col("event_id")))
                            .otherwise(body).cast("binary").alias("value"))

    def line_messages(self) -> DataFrame:
        """JSON text of a transaction per order line with that line as its only product."""
        product = F.struct("product_id", "quantity", F.col("unit_price").alias("price"))
        return self.order_lines().select(F.to_json(F.struct(
            "transaction_id", "user_id", _iso(F.col("timestamp")).alias("timestamp"),
            F.array(product).alias("products"), "total_amount", "payment_method", "country")).alias("value"))

    def baskets(self) -> DataFrame:
        """One transaction per order line, holding its product l_linenumber - 1 times.

        Sizes run from an empty array to six products without gathering the lines of an order.
        """
        product = F.struct("product_id", "quantity", F.col("unit_price").alias("price"))
        return self.order_lines().select(
            "transaction_id", "user_id", "timestamp",
            F.array_repeat(product, F.col("l_linenumber") - 1).alias("products"),
            "total_amount", "payment_method", "country", "l_linenumber", "l_suppkey")

    def basket_messages(self) -> DataFrame:
        """Basket JSON with a defect chosen by ``d``; even orders carry the exact total."""
        order = F.col("transaction_id").cast("bigint")
        lines = self.order_lines().withColumns({
            "n": F.col("l_linenumber") - 1, "d": ((order + F.col("l_linenumber")) % 12).cast("int")})
        d = F.col("d")
        product = F.struct("product_id", F.when(d == 6, 0).otherwise(F.col("quantity")).alias("quantity"),
                           F.col("unit_price").alias("price"))
        total = F.when(order % 2 == 0, from_cents(line_cents("quantity", "unit_price") * F.col("n"))) \
            .otherwise(F.col("total_amount"))
        text = F.concat_ws("-", "transaction_id", F.col("l_linenumber").cast("string"),
                           F.col("l_suppkey").cast("string"))
        lines = lines.withColumn("message_id", _uuid(text))
        body = F.to_json(F.struct(
            F.when(d == 0, F.col("transaction_id")).otherwise(F.col("message_id")).alias("transaction_id"),
            F.when(d == 3, F.lower("user_id")).otherwise(F.col("user_id")).alias("user_id"),
            F.when(d == 4, "yesterday").otherwise(_iso(F.col("timestamp"))).alias("timestamp"),
            F.array_repeat(product, F.col("n")).alias("products"),
            total.alias("total_amount"),
            F.when(d == 5, "Cash").otherwise(F.col("payment_method")).alias("payment_method"),
            F.when(d != 1, F.col("country")).alias("country")))
        # With d = 2 the total is quoted, which makes it a string.
        value = (F.when(d == 7, F.lit('{"transaction_id":'))
                 .when(d == 2, F.regexp_replace(body, '"total_amount":([^,]+),', '"total_amount":"$1",'))
                 .otherwise(body))
        return lines.select("message_id", F.lit("transaction").alias("kind"), value.alias("value"))

    def checked_cart_messages(self) -> DataFrame:
        """Cart JSON whose defects follow from k."""
        k = F.col("k")
        part = self.raw("part").select("p_partkey", "p_type", "p_retailprice")
        carts = self._carts().join(part, k == F.col("p_partkey"))
        kind, price = F.col("event_type"), F.col("p_retailprice")
        in_checkout, in_update = kind == "checkout", kind == "update_quantity"
        n, each = k % 4, k % 3 + 1
        item = F.struct(_id("PROD_", k).alias("product_id"), each.alias("quantity"), price.alias("price"))
        total = from_cents(line_cents(each, price) * n) + F.when(k % 2 == 0, 0.0).otherwise(1.0)
        body = F.to_json(F.struct(
            _uuid(F.col("event_id")).alias("event_id"),
            F.when(k == 7, "wish").otherwise(kind).alias("event_type"),
            _iso(F.col("timestamp")).alias("timestamp"), "user_id",
            F.when(k == 11, F.col("session_id")).otherwise(_uuid(F.col("session_id"))).alias("session_id"),
            "product_id",
            F.when(~in_checkout, F.col("p_type")).alias("category"),
            F.when(~in_checkout, price).alias("price"), "quantity",
            F.when(in_update, k % 3).alias("old_quantity"), F.when(in_update, k % 2 + 1).alias("new_quantity"),
            F.when(~in_checkout, F.when(k == 19, -1.0).otherwise(F.col("cart_value"))).alias("cart_value"),
            F.when(in_checkout, F.array_repeat(item, n)).alias("items"),
            F.when(in_checkout, n).alias("total_items"), F.when(in_checkout, total).alias("total_value"),
            "country"))
        return carts.select(_uuid(F.col("event_id")).alias("message_id"), F.lit("cart_event").alias("kind"),
                            body.alias("value"))

    def checked_view_messages(self) -> DataFrame:
        """View JSON whose defects follow from k."""
        k, kind = F.col("k"), F.col("event_type")

        def body(from_search: Column) -> Column:
            return F.to_json(F.struct(
                _uuid(F.col("event_id")).alias("event_id"), "event_type",
                _iso(F.col("timestamp")).alias("timestamp"), "user_id",
                _uuid(F.col("session_id")).alias("session_id"),
                F.when(k == 3, F.lit("P-3")).otherwise(F.col("product_id")).alias("product_id"),
                F.when((kind == "view") & (k == 23), "").otherwise(F.col("product_name")).alias("product_name"),
                "category", F.when(k == 29, F.col("price") * -1).otherwise(F.col("price")).alias("price"),
                F.when(k == 31, F.col("view_duration") * 1000).otherwise(F.col("view_duration")).alias("view_duration"),
                F.when(kind == "view", from_search).alias("from_search"),
                F.when((kind == "search") & (k % 10 == 0), "").otherwise(F.col("search_query")).alias("search_query"),
                "results_count",
                F.when(kind == "filter", k * 10).alias("min_price"), F.when(kind == "filter", 500).alias("max_price"),
                F.when(kind == "compare", F.array_repeat(_id("PROD_", k), k % 4)).alias("product_ids"),
                "country"))
        value = F.when(k % 20 == 0, body(F.lit("yes"))).otherwise(body(F.lit(True)))
        return self._views().select(_uuid(F.col("event_id")).alias("message_id"),
                                    F.lit("product_view").alias("kind"), value.alias("value"))


def _uuid(text: Column) -> Column:
    """32 hex digits of a digest in 8-4-4-4-12 form."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
