"""Threshold labels and deterministic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(value: Column | str, cuts: Sequence[tuple[float, object]], default: object) -> Column:
    """Label of the first cut (highest first) that ``value`` reaches."""
    return _ladder(value, cuts, default, lambda v, cut: v >= cut)


def at_most(value: Column | str, cuts: Sequence[tuple[float, object]], default: object) -> Column:
    """Label of the first cut (lowest first) that ``value`` does not exceed."""
    return _ladder(value, cuts, default, lambda v, cut: v <= cut)


def _ladder(value, cuts, default, test) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    (first, label), *rest = cuts
    chain = F.when(test(v, first), F.lit(label))
    for cut, label in rest:
        chain = chain.when(test(v, cut), F.lit(label))
    return chain.otherwise(F.lit(default))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    (first, label), *rest = rules
    chain = F.when(first, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def content_id(*parts: Column | str) -> Column:
    """Id that a replay of the same record reproduces; a NULL part keeps its place."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]), 256)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def distinct_count(column: Column | str, exact: bool) -> Column:
    """Sketch by default (legal in streams); exact for batch reports."""
    return F.count_distinct(F.col(column) if isinstance(column, str) else column) if exact \
        else F.approx_count_distinct(column)
