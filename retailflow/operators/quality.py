"""Event validation as column expressions over the JSON text of a message.

The message is parsed once to a VARIANT and shredded in one pass to the declared fields, so
a missing field, a JSON null and a value of the wrong JSON type stay distinguishable. Kind,
text and number of every field become plain columns first; the rules then only compare
those. ``validate`` adds ``errors``: the broken rules in declaration order, each as
``<rule>:<field>``; an empty array means the event is valid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import VOCABULARY, Vocabulary
from retailflow.functions.eventtime import parse_iso

# --- fixed values: formats of the event fields ---------------------------------
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
USER_ID = "^USER_[0-9]+$"
PRODUCT_ID = "^PROD_[0-9]+$"
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Constraints on one JSON field, or on the elements of an array field.

    A property of an array element with ``checked=False`` is only read by business rules.
    """
    name: str
    kind: str
    nullable: bool = False
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    min_items: int | None = None
    max_items: int | None = None
    date_time: bool = False
    element: "Field | None" = None
    properties: tuple["Field", ...] = ()
    required: bool = False
    checked: bool = True


class Facts:
    """Columns that describe the fields of one message, or the properties of one array element."""

    def __init__(self, at: Callable[[str], Column]):
        self._at = at

    def present(self) -> Column:
        return self._at("present")

    def here(self, name: str) -> Column:
        return self._at(f"kind_{name}").isNotNull()

    def kind(self, name: str) -> Column:
        return self._at(f"kind_{name}")

    def text(self, name: str) -> Column:
        return self._at(f"text_{name}")

    def number(self, name: str) -> Column:
        return self._at(f"number_{name}")

    def items(self, name: str) -> Column:
        return self._at(f"items_{name}")


#: A business rule: name and a function from the message facts to "is broken".
Rule = tuple[str, Callable[[Facts], Column]]


@dataclass(frozen=True)
class Ruleset:
    fields: tuple[Field, ...]
    business: tuple[Rule, ...] = field(default=())


def _shape(fields: Sequence[Field]) -> str:
    return "struct<" + ",".join(f"`{f.name}`: variant" for f in fields) + ">"


def _scalar_facts(f: Field, value: Column) -> dict[str, Column]:
    """Kind of a value (NULL when absent), its text, and its number when it has one."""
    facts = {f"kind_{f.name}": F.schema_of_variant(value)}
    if f.kind == "string":
        facts[f"text_{f.name}"] = F.try_variant_get(value, "$", "string")
    if f.kind in ("integer", "number"):
        facts[f"number_{f.name}"] = F.try_variant_get(value, "$", "double")
    return facts


def _array_facts(f: Field, value: Column) -> dict[str, Column]:
    """An array is told by its elements; the schema of all of them is never computed."""
    def cast(element: str) -> Column:
        return F.try_variant_get(value, "$", f"array<{element}>")

    kind = F.when(cast("variant").isNotNull(), "ARRAY").when(value.isNotNull(), "OTHER")
    parts = f.element.properties or (f.element,) if f.element else ()

    def describe(item: Column) -> Column:
        facts: dict[str, Column] = {}
        for p in parts:
            facts |= _scalar_facts(p, item[p.name] if f.element.properties else item)
        return F.struct(item.isNotNull().alias("present"), *[c.alias(n) for n, c in facts.items()])

    if not parts:
        described = cast("variant")
    else:
        # An element that is no object becomes NULL.
        described = F.transform(cast(_shape(parts) if f.element.properties else "variant"), describe)
    return {f"kind_{f.name}": kind, f"items_{f.name}": described}


def _is_kind(kind: Column, wanted: str) -> Column:
    """``kind`` is the type name Spark gives a variant value."""
    match wanted:
        case "string":
            return kind == "STRING"
        case "boolean":
            return kind == "BOOLEAN"
        case "integer":
            return (kind == "BIGINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)"))
        case "number":
            return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        case "array":
            return kind == "ARRAY"
    raise ValueError(wanted)


def _when(broken: Column, rule: str, name: str) -> Column:
    return F.when(broken, F.lit(f"{rule}:{name}"))


def _bounds(f: Field, facts: Facts) -> list[tuple[str, Column]]:
    """Constraint tests that apply to a value of the right kind."""
    tests = []
    if f.pattern:
        tests.append(("pattern", ~facts.text(f.name).rlike(f.pattern)))
    if f.date_time:
        tests.append(("format", parse_iso(facts.text(f.name)).isNull()))
    if f.minimum is not None:
        tests.append(("minimum", facts.number(f.name) < f.minimum))
    if f.maximum is not None:
        tests.append(("maximum", facts.number(f.name) > f.maximum))
    if f.min_length is not None:
        tests.append(("min_length", F.length(facts.text(f.name)) < f.min_length))
    return tests


def _field_checks(f: Field, facts: Facts) -> list[Column]:
    kind = facts.kind(f.name)
    right = _is_kind(kind, f.kind)
    fine = right | (kind == "VOID") if f.nullable else right
    checks = [_when(~fine, "type", f.name)]
    checks += [_when(right & broken, rule, f.name) for rule, broken in _bounds(f, facts)]
    if f.allowed is not None:
        checks.append(_when(kind.isNotNull() & ~F.coalesce(facts.text(f.name).isin(*f.allowed), F.lit(False)),
                            "enum", f.name))
    return checks + (_array_checks(f, facts.items(f.name)) if f.kind == "array" else [])


def _array_checks(f: Field, items: Column) -> list[Column]:
    checks = []
    if f.min_items is not None:
        checks.append(_when(F.size(items) < f.min_items, "min_items", f.name))
    if f.max_items is not None:
        checks.append(_when(F.size(items) > f.max_items, "max_items", f.name))
    element = f.element
    if element is None:
        return checks

    def some(test: Callable[[Facts], Column]) -> Column:
        return F.exists(items, lambda i: test(Facts(lambda name: i[name])))

    def right(p: Field, e: Facts) -> Column:
        return F.coalesce(_is_kind(e.kind(p.name), p.kind), F.lit(False))

    if not element.properties:
        name = f"{f.name}[]"
        checks.append(_when(some(lambda e: ~right(element, e)), "type", name))
        for at, (rule, _) in enumerate(_bounds(element, Facts(lambda name: F.lit(None)))):
            checks.append(_when(some(lambda e, at=at: right(element, e) & _bounds(element, e)[at][1]), rule, name))
        return checks
    checked = [p for p in element.properties if p.checked]
    if checked:
        checks.append(_when(F.exists(items, lambda i: ~i["present"]), "type", f"{f.name}[]"))
    for p in checked:
        def broken(e: Facts, p: Field = p) -> Column:
            bad = ~right(p, e)
            for _, test in _bounds(p, e):
                bad = bad | test
            return e.present() & F.coalesce(bad, F.lit(True))
        checks.append(_when(some(broken), "item", f"{f.name}[].{p.name}"))
    return checks


def _describe(parsed: DataFrame, rules: Ruleset) -> DataFrame:
    """Facts of every declared field as columns of their own, each computed once."""
    facts: dict[str, Column] = {}
    for f in rules.fields:
        value = F.col(f"_fields.{f.name}")
        facts |= _array_facts(f, value) if f.kind == "array" else _scalar_facts(f, value)
    return parsed.select("*", *[c.alias(f"_{name}") for name, c in facts.items()])


def validate(messages: DataFrame, rules: Ruleset, value: str = "value") -> DataFrame:
    """Add ``errors``; text that is not a JSON object gives the single error ``malformed``."""
    message = F.try_parse_json(F.col(value).cast("string"))
    described = _describe(
        messages.withColumn("_fields", F.try_variant_get(message, "$", _shape(rules.fields))), rules)
    facts = Facts(lambda name: F.col(f"_{name}"))
    checks = [_when(~facts.here(f.name), "required", f.name) for f in rules.fields if f.required]
    for f in rules.fields:
        checks += _field_checks(f, facts)
    checks += [F.when(broken(facts), F.lit(f"rule:{name}")) for name, broken in rules.business]
    # Dropping NULLs with a set difference keeps the checks compiled; a lambda would interpret them.
    broken_rules = F.array_except(F.array(*checks), F.array(F.lit(None).cast("string")))
    errors = F.when(F.col("_fields").isNull(), F.array(F.lit("malformed"))).otherwise(broken_rules)
    return described.select(*messages.columns, errors.alias("errors"))


def valid(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def require_valid(validated: DataFrame) -> DataFrame:
    """Strict mode: the first invalid event fails the job."""
    message = F.concat(F.lit("event failed validation: "), F.concat_ws(", ", "errors"))
    return (validated
            .filter(F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
            .drop("errors"))


def first_errors(validated: DataFrame, *keys: str) -> DataFrame:
    """Events per first error; valid events are counted under NULL."""
    return (validated.groupBy(*keys, F.try_element_at("errors", F.lit(1)).alias("error"))
            .agg(F.count(F.lit(1)).alias("events")))


def pass_rates(validated: DataFrame, *keys: str) -> DataFrame:
    passed = F.count(F.when(F.size("errors") == 0, 1))
    total = F.count(F.lit(1))
    return validated.groupBy(*keys).agg(
        total.alias("total_validated"), passed.alias("total_passed"), (total - passed).alias("total_failed"),
        (passed / total * 100).alias("pass_rate"))


# --- rulesets --------------------------------------------------------------------

def _sum_of(items: Column) -> Column:
    """sum(quantity * price) over described items; missing parts count 0."""
    zero = F.lit(0.0)
    return F.aggregate(items, zero, lambda total, i: total + F.coalesce(i["number_quantity"], zero)
                       * F.coalesce(i["number_price"], zero))


def _differs(a: Column, b: Column) -> Column:
    """Apart by more than a cent; compared in whole hundredths of a cent to keep 0.01 itself legal."""
    return F.abs(F.rint((a - b) * 10000.0)) > 100


def _total_mismatch(array: str, total: str, subtype: str | None = None) -> Callable[[Facts], Column]:
    def broken(m: Facts) -> Column:
        items = m.items(array)
        bad = (F.size(items) > 0) & _differs(_sum_of(items), F.coalesce(m.number(total), F.lit(0.0)))
        return (m.text("event_type") == subtype) & bad if subtype else bad
    return broken


def _no_items(m: Facts) -> Column:
    empty = F.coalesce(F.size(m.items("items")) <= 0, F.lit(True))
    none = F.coalesce(m.number("total_items"), F.lit(0.0)) == 0
    return (m.text("event_type") == "checkout") & (empty | none)


def _same_quantity(m: Facts) -> Column:
    return (m.text("event_type") == "update_quantity") & (m.number("old_quantity") == m.number("new_quantity"))


def _no_query(m: Facts) -> Column:
    return (m.text("event_type") == "search") & (F.coalesce(m.text("search_query"), F.lit("")) == "")


def _too_few_compared(m: Facts) -> Column:
    return (m.text("event_type") == "compare") & (F.coalesce(F.size(m.items("product_ids")), F.lit(0)) < 2)


def _inverted_range(m: Facts) -> Column:
    return m.number("min_price") > m.number("max_price")


def transaction_rules(words: Vocabulary = VOCABULARY) -> Ruleset:
    product = Field("product", "object", properties=(
        Field("product_id", "string", pattern=PRODUCT_ID),
        Field("quantity", "integer", minimum=1, maximum=100),
        Field("price", "number", minimum=0, maximum=10000)))
    return Ruleset(
        fields=(
            Field("transaction_id", "string", required=True, pattern=UUID),
            Field("user_id", "string", required=True, pattern=USER_ID),
            Field("timestamp", "string", required=True, date_time=True),
            Field("products", "array", required=True, min_items=1, max_items=5, element=product),
            Field("total_amount", "number", required=True, minimum=0, maximum=50000),
            Field("payment_method", "string", required=True, allowed=words.payment_methods),
            Field("country", "string", required=True, allowed=words.countries)),
        business=(("total_mismatch", _total_mismatch("products", "total_amount")),))


def _event_head(words: Vocabulary, types: Sequence[str]) -> tuple[Field, ...]:
    return (
        Field("event_id", "string", required=True, pattern=UUID),
        Field("event_type", "string", required=True, allowed=tuple(types)),
        Field("timestamp", "string", required=True, date_time=True),
        Field("user_id", "string", required=True, pattern=USER_ID),
        Field("session_id", "string", required=True, pattern=UUID),
        Field("product_id", "string", pattern=PRODUCT_ID),
        Field("product_name", "string", min_length=1))


def cart_rules(words: Vocabulary = VOCABULARY) -> Ruleset:
    return Ruleset(
        fields=_event_head(words, words.cart_event_types) + (
            Field("category", "string", allowed=words.categories),
            Field("price", "number", minimum=0, maximum=10000),
            Field("quantity", "integer", minimum=0, maximum=100),
            Field("old_quantity", "integer", minimum=0),
            Field("new_quantity", "integer", minimum=0),
            Field("cart_size", "integer", minimum=0, maximum=100),
            Field("cart_value", "number", minimum=0),
            Field("items", "array", element=Field("item", "object", properties=(
                Field("quantity", "integer", checked=False), Field("price", "number", checked=False)))),
            Field("total_items", "integer", minimum=0),
            Field("total_value", "number", minimum=0),
            Field("country", "string", required=True, allowed=words.countries)),
        business=(
            ("checkout_without_items", _no_items),
            ("checkout_total_mismatch", _total_mismatch("items", "total_value", "checkout")),
            ("quantity_unchanged", _same_quantity)))


def view_rules(words: Vocabulary = VOCABULARY) -> Ruleset:
    return Ruleset(
        fields=_event_head(words, words.view_event_types) + (
            Field("category", "string", nullable=True),
            Field("price", "number", minimum=0, maximum=10000),
            Field("view_duration", "integer", minimum=0, maximum=3600),
            Field("from_search", "boolean"),
            Field("search_query", "string", nullable=True),
            Field("previously_viewed_count", "integer", minimum=0),
            Field("results_count", "integer", minimum=0),
            Field("filter_category", "string", nullable=True),
            Field("min_price", "number", nullable=True, minimum=0),
            Field("max_price", "number", nullable=True, minimum=0),
            Field("product_ids", "array", element=Field("id", "string", pattern=PRODUCT_ID)),
            Field("product_names", "array", element=Field("name", "string")),
            Field("prices", "array", element=Field("price", "number", minimum=0)),
            Field("country", "string", required=True, allowed=words.countries)),
        business=(
            ("search_without_query", _no_query),
            ("compare_too_few", _too_few_compared),
            ("price_range_inverted", _inverted_range)))
