"""Filters over logical fields: each condition becomes one Column, so Catalyst
pushes it to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.fields import ARRAY, BOOLEAN, ENUM, INTEGER, NUMBER, OPERATORS, STRING, TIMESTAMP, Table

MAX_FILTERS, MAX_VALUES = 25, 200
MAX_RANGE_NS = 400 * 86_400 * 10**9
Condition = tuple[str, str, Any]


def column(table: Table, name: str) -> Column:
    """A field's column; ``map.key`` looks a key up (null where absent)."""
    field = table.field(name)
    head, _, key = name.partition(".")
    if key and field.physical == name:
        return F.try_element_at(F.col(head), F.lit(key))
    return F.col(field.physical)


def _scaled(value: Any, scale: int) -> Any:
    return int(value * scale) if scale != 1 else value


def predicate(table: Table, condition: Condition) -> Column:
    """One condition ``(field, operator, value)``.

    ``between`` is half-open; string operators match literally; ``is_null``
    also matches an empty string; values in milliseconds are cut to whole ns.
    """
    name, op, value = condition
    field, c = table.field(name), column(table, name)
    if op not in OPERATORS[field.kind]:
        raise ValueError(f"{op!r} does not apply to {name!r}; use one of {', '.join(OPERATORS[field.kind])}")
    many = list(value) if op in ("in", "not_in", "has_any", "has_all", "between") else [value]
    if len(many) > MAX_VALUES:
        raise ValueError(f"at most {MAX_VALUES} values")
    if field.values and op in ("eq", "ne", "in", "not_in") and (bad := set(many) - set(field.values)):
        raise ValueError(f"{name!r} has no value {sorted(bad)}; known: {', '.join(field.values)}")
    many = [_scaled(v, field.scale) for v in many] if value is not None else many
    if op == "between" and (len(many) != 2 or many[0] > many[1]):
        raise ValueError("between takes lo and hi, lo <= hi")
    empty = c.isNull() | (c == "") if field.kind in (STRING, ENUM) else c.isNull() | (F.size(c) == 0) if field.kind == ARRAY else c.isNull()
    return {
        "eq": lambda: c == many[0],
        "ne": lambda: c != many[0],
        "gt": lambda: c > many[0],
        "gte": lambda: c >= many[0],
        "lt": lambda: c < many[0],
        "lte": lambda: c <= many[0],
        "in": lambda: c.isin(many),
        "not_in": lambda: ~c.isin(many),
        "contains": lambda: c.contains(many[0]),
        "starts_with": lambda: c.startswith(many[0]),
        "ends_with": lambda: c.endswith(many[0]),
        "has": lambda: F.array_contains(c, many[0]),
        "has_any": lambda: F.arrays_overlap(c, F.array(*map(F.lit, many))),
        "has_all": lambda: reduce(lambda a, b: a & b, (F.array_contains(c, v) for v in many)),
        "between": lambda: (c >= many[0]) & (c < many[1]),
        "is_null": lambda: empty,
        "is_not_null": lambda: ~empty,
    }[op]()


def scope(organization: str, project: str | None = None, environment: str | None = None) -> Column:
    out = F.col("organization_id") == organization
    for name, value in (("project_id", project), ("environment", environment)):
        out = out & (F.col(name) == value) if value is not None else out
    return out


def time_range(table: Table, start_ns: int, end_ns: int) -> Column:
    """Half-open; at most 400 days."""
    if end_ns <= start_ns or end_ns - start_ns > MAX_RANGE_NS:
        raise ValueError("the range must be positive and at most 400 days")
    return (F.col(table.time) >= start_ns) & (F.col(table.time) < end_ns)


def text_query(table: Table, text: str) -> Column:
    """The name contains the text, or an identifier equals it."""
    name, *ids = table.text
    return reduce(lambda a, b: a | b, (F.col(i) == text for i in ids), F.col(name).contains(text))


#: Texts that stand for true and false.
TRUTH = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}


def coerce(table: Table, name: str, token: str) -> Any:
    """A filter's text as a value of the field's type; raises ValueError with
    what the field would take."""
    kind = table.field(name).kind
    try:
        if kind == INTEGER:
            return int(token)
        if kind == NUMBER:
            return float(token)
        if kind == TIMESTAMP:
            at = datetime.fromisoformat(token)
            return at if at.tzinfo else at.replace(tzinfo=UTC)
        if kind == BOOLEAN:
            return TRUTH[token.strip().lower()]
    except (ValueError, KeyError):
        raise ValueError(f"{token!r} is no {kind} value for {name!r}") from None
    allowed = table.field(name).values
    if allowed and token not in allowed:
        raise ValueError(f"{name!r} has no value {token!r}; known: {', '.join(allowed)}")
    return token


AUDITED = ("action", "actor_id", "resource_type", "resource_id", "project_id", "outcome")


def audit(events: DataFrame, organization: str, conditions: Sequence[Condition] = (), start: Any = None, end: Any = None, after: tuple[Any, Any] | None = None, limit: int = 50) -> DataFrame:
    """A page of an organization's audit events, newest first, one row more
    than the page to tell whether another follows.  Conditions on other fields,
    or with other operators, are passed over; starts_with and contains take
    ``%`` and ``_`` as wildcards."""
    out = events.filter(F.col("organization_id") == organization)
    out = out if start is None else out.filter(F.col("occurred_at") >= start)
    out = out if end is None else out.filter(F.col("occurred_at") < end)
    for name, op, value in conditions:
        c = F.col(name) if name in AUDITED else None
        tests = {"eq": lambda: c == value, "ne": lambda: c != value, "in": lambda: c.isin(list(value)), "starts_with": lambda: c.like(f"{value}%"), "contains": lambda: c.like(f"%{value}%")}
        out = out.filter(tests[op]()) if c is not None and op in tests else out
    if after is not None:
        out = out.filter((F.col("occurred_at") < after[0]) | ((F.col("occurred_at") == after[0]) & (F.col("id") < after[1])))
    return out.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit + 1)


def where(df: DataFrame, table: Table, conditions: Sequence[Condition] = (), *more: Column) -> DataFrame:
    if len(conditions) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    for c in (*more, *(predicate(table, x) for x in conditions)):
        df = df.filter(c)
    return df
