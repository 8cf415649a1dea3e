"""The store's query language as Column predicates and scores. Anything outside it is refused."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.functions.a1 import overlaps
from quartzgrid.functions.text import tokens

_COMPARE = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}


class UnsupportedQuery(ValueError):
    """A clause that the language doesn't have."""


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class QueryCompiler:
    """Turns a nested query dict into (predicate, score) over a DataFrame's columns.

    match_all, term, terms, match, range, bool and nested. A `range` on a struct with `gte` and `lte` fields, or on a
    name with columns <name>_lo and <name>_hi, is interval intersection. Nulls never match. Filters and exclusions add nothing to the score.
    """

    def __init__(self, df: DataFrame) -> None:
        self.types = dict(df.dtypes)

    def compile(self, query: dict[str, Any], field=None) -> tuple[Column, Column]:
        if len(query) != 1:
            raise UnsupportedQuery(f"one clause expected, not {sorted(query)}")
        (name, body), = query.items()
        field = field or F.col
        if name == "match_all":
            return F.lit(True), F.lit(1.0)
        if name == "bool":
            return self._bool(body, field)
        if name == "nested":
            return self._nested(body)
        if name not in ("term", "terms", "match", "range"):
            raise UnsupportedQuery(f"clause {name} is not supported")
        (column, condition), = body.items()
        predicate = _false_if_null(getattr(self, f"_{name}")(column, condition, field))
        return predicate, F.when(predicate, 1.0).otherwise(0.0)

    def _is_array(self, column: str) -> bool:
        return self.types.get(column, "").startswith("array")

    def _term(self, column: str, condition: Any, field) -> Column:
        value = condition.get("value") if isinstance(condition, dict) else condition
        return F.array_contains(field(column), value) if self._is_array(column) else field(column) == F.lit(value)

    def _terms(self, column: str, values: list[Any], field) -> Column:
        if not values:
            return F.lit(False)
        return F.arrays_overlap(field(column), F.array(*map(F.lit, values))) if self._is_array(column) else field(column).isin(*values)

    def _match(self, column: str, condition: Any, field) -> Column:
        text = condition.get("query") if isinstance(condition, dict) else condition
        value = F.array_join(field(column), " ") if self._is_array(column) else field(column).cast("string")
        return F.arrays_overlap(tokens(value), tokens(F.lit(text)))

    def _range(self, column: str, bounds: dict[str, Any], field) -> Column:
        if unknown := set(bounds) - set(_COMPARE):
            raise UnsupportedQuery(f"range bounds {sorted(unknown)}")
        if f"{column}_lo" in self.types:
            low, high = field(f"{column}_lo"), field(f"{column}_hi")
            return overlaps(low, high, F.lit(bounds.get("gte", -(1 << 62))), F.lit(bounds.get("lte", 1 << 62)))
        return reduce(and_, (getattr(field(column), _COMPARE[k])(F.lit(v)) for k, v in bounds.items()), F.lit(True))

    def _bool(self, body: dict[str, Any], field) -> tuple[Column, Column]:
        if unknown := set(body) - {"must", "filter", "should", "must_not", "minimum_should_match"}:
            raise UnsupportedQuery(f"bool parts {sorted(unknown)}")
        parts = {k: [self.compile(q, field) for q in (v if isinstance(v, list) else [v])] for k, v in body.items() if k != "minimum_should_match"}
        least = body.get("minimum_should_match", 1 if parts.get("should") and not parts.get("must") and not parts.get("filter") else 0)
        holds = [p for k in ("must", "filter") for p, _ in parts.get(k, [])] + [~p for p, _ in parts.get("must_not", [])]
        should = [s for _, s in parts.get("should", [])]
        met = reduce(lambda a, b: a + b, (F.when(p, 1).otherwise(0) for p, _ in parts.get("should", [])), F.lit(0))
        predicate = reduce(and_, [*holds, met >= least])
        return predicate, reduce(lambda a, b: a + b, [s for _, s in parts.get("must", [])] + should, F.lit(0.0))

    def _nested(self, body: dict[str, Any]) -> tuple[Column, Column]:
        """Some element of the array `path` meets the inner query, whose fields are named path.field."""
        path = body["path"]
        inner = QueryCompiler.__new__(QueryCompiler)
        inner.types = {}
        predicate = _false_if_null(F.exists(F.col(path), lambda x: inner.compile(body["query"], lambda name: x[name.removeprefix(f"{path}.")])[0]))
        return predicate, F.when(predicate, 1.0).otherwise(0.0)


def search(df: DataFrame, query: dict[str, Any], id_column: str, size: int, columns: list[str] | None = None) -> DataFrame:
    """The best `size` rows, score descending and id ascending, with their score."""
    predicate, score = QueryCompiler(df).compile(query)
    found = df.where(predicate).withColumn("score", score).orderBy(F.col("score").desc(), id_column).limit(size)
    return found.select(*columns, "score") if columns else found


def any_of(predicates: list[Column]) -> Column:
    return reduce(or_, predicates, F.lit(False))
