"""Predicates to two-valued Columns: a missing value makes a leaf false, so NOT is the complement."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlog.plans import ir


@dataclass(frozen=True)
class Field:
    """Where a name leads: a typed column, a path in the open map, or nowhere."""

    column: Column | None
    kind: str  # number, boolean, string, other, variant, absent


class Resolver:
    """Columns of the table win; other names are looked up in its VARIANT column ``fields``."""

    def __init__(self, df: DataFrame, open_map: str = "fields"):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.open_map = open_map if open_map in self.types else None

    def __call__(self, name: str) -> Field:
        kind = self.types.get(name)
        if kind is not None and name != self.open_map:
            if isinstance(kind, T.BooleanType):
                return Field(F.col(name), "boolean")
            if isinstance(kind, T.NumericType):
                return Field(F.col(name), "number")
            if isinstance(kind, T.VariantType):
                return Field(F.col(name), "variant")
            return Field(F.col(name), "string" if isinstance(kind, T.StringType) else "other")
        if self.open_map:
            return Field(F.variant_get(F.col(self.open_map), f"$.{name}", "variant"), "variant")
        return Field(None, "absent")


_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _false() -> Column:
    return F.lit(False)


def _two_valued(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def as_number(field: Field) -> Column | None:
    """The value as a double if it is a number or a truth value, else null; None if it never is."""
    if field.kind in ("number", "boolean"):
        return field.column.cast("double")
    if field.kind == "variant":
        kind = F.schema_of_variant(field.column)
        truth = F.try_variant_get(field.column, "$", "boolean").cast("double")
        return F.when(kind == "BOOLEAN", truth).when(kind.rlike(_NUMBER), F.try_variant_get(field.column, "$", "double"))
    return None


def as_string(field: Field) -> Column | None:
    if field.kind == "string":
        return field.column
    if field.kind == "variant":
        return F.when(F.schema_of_variant(field.column) == "STRING", F.try_variant_get(field.column, "$", "string"))
    return None


def present(field: Field) -> Column:
    if field.kind == "absent":
        return _false()
    if field.kind == "variant":
        return field.column.isNotNull() & ~_two_valued(F.is_variant_null(field.column))
    return field.column.isNotNull()


def equals(field: Field, value) -> Column:
    if value is None:
        return ~present(field)
    side = as_string(field) if isinstance(value, str) else as_number(field)
    if side is None:
        return _false()
    return _two_valued(side == F.lit(value if isinstance(value, str) else float(value)))


def within(field: Field, span: ir.Interval) -> Column:
    ends = [x for x in (span.low, span.high) if x is not None]
    if not ends:
        return present(field)
    side = as_string(field) if all(isinstance(x, str) for x in ends) else as_number(field)
    if side is None or len({isinstance(x, str) for x in ends}) > 1:
        return _false()
    parts = []
    if span.low is not None:
        parts.append(side > F.lit(span.low) if span.low_open else side >= F.lit(span.low))
    if span.high is not None:
        parts.append(side < F.lit(span.high) if span.high_open else side <= F.lit(span.high))
    return _two_valued(reduce(lambda a, b: a & b, parts))


def compile_leaf(leaf: ir.Predicate, resolve: Resolver) -> Column:
    field = resolve(leaf.field)
    if leaf.op == ir.EXISTS:
        return present(field)
    if leaf.op == ir.EQ:
        return equals(field, leaf.value)
    if leaf.op == ir.NE:
        return present(field) & ~equals(field, leaf.value)
    if leaf.op == ir.RANGE:
        return within(field, leaf.value)
    if leaf.op == ir.IN:
        strings = [v for v in leaf.value if isinstance(v, str)]
        numbers = [float(v) for v in leaf.value if not isinstance(v, str)]
        sides = [(as_string(field), strings), (as_number(field), numbers)]
        parts = [_two_valued(side.isin(values)) for side, values in sides if side is not None and values]
        return reduce(lambda a, b: a | b, parts) if parts else _false()
    if leaf.op in (ir.MATCH, ir.NOT_MATCH):
        side = as_string(field)
        if side is None:
            return _false()
        return _two_valued(side.rlike(str(leaf.value)) if leaf.op == ir.MATCH else ~side.rlike(str(leaf.value)))
    raise ValueError(f"unknown operator {leaf.op}")


def compile_expr(expr, resolve: Resolver) -> Column:
    if isinstance(expr, ir.Predicate):
        return compile_leaf(expr, resolve)
    if isinstance(expr, ir.Not):
        return ~compile_expr(expr.part, resolve)
    join = (lambda a, b: a & b) if isinstance(expr, ir.And) else (lambda a, b: a | b)
    return reduce(join, (compile_expr(p, resolve) for p in expr.parts))


def sort_key(name: str, resolve: Resolver) -> Column:
    """Strings as they are, nulls first; anything else as a number, missing as 0."""
    field = resolve(name)
    if field.kind == "string":
        return field.column
    number = as_number(field)
    return F.coalesce(number, F.lit(0.0)) if number is not None else F.lit(0.0)
