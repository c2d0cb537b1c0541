"""The query language as data: leaves, boolean nodes and a query."""

from __future__ import annotations

from dataclasses import dataclass

EQ, NE, IN, EXISTS, RANGE, MATCH, NOT_MATCH = "=", "!=", "in", "exists", "range", "=~", "!~"


@dataclass(frozen=True)
class Interval:
    """Bounds of a range; None is open-ended. Both ends belong to it unless they are marked open."""

    low: float | str | None = None
    high: float | str | None = None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object = None

    def key(self) -> str:
        """What frequencies are kept by: the value doesn't take part."""
        return f"{self.field}|{self.op}"


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    where: object
    time_range: tuple[float, float] | None = None
    limit: int | None = None
    order_by: Order | None = None


def leaves(expr) -> list[Predicate]:
    """All predicates, those beneath NOT too, from left to right."""
    if isinstance(expr, Predicate):
        return [expr]
    parts = expr.parts if isinstance(expr, And | Or) else (expr.part,)
    return [leaf for part in parts for leaf in leaves(part)]
