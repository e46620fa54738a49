"""Sorting, keyset pages and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.fields import Table

MAX_TERMS, DEFAULT_LIMIT, MAX_LIMIT = 4, 50, 500


def terms(table: Table, sort: Sequence[str] = ()) -> list[tuple[str, bool]]:
    """``(column, descending)`` for each term; the tiebreaker comes last and
    takes the last term's direction."""
    if len(sort) > MAX_TERMS or len({s.lstrip("+-") for s in sort}) < len(sort):
        raise ValueError(f"at most {MAX_TERMS} different sort terms")
    out = []
    for s in sort or table.sort:
        field = table.field(s.lstrip("+-"))
        if not field.sortable:
            raise ValueError(f"{field.name!r} can't be sorted by")
        out.append((field.physical, s.startswith("-")))
    if table.tiebreak not in [c for c, _ in out]:
        out.append((table.tiebreak, out[-1][1]))
    return out


def order(by: Sequence[tuple[str, bool]]) -> list[Column]:
    """Nulls first when ascending and last when descending."""
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in by]


def after(by: Sequence[tuple[str, bool]], cursor: Mapping[str, Any]) -> Column:
    """Rows behind the cursor row in this order (nulls are the least value)."""

    def beyond(c: str, descending: bool) -> Column:
        v, col = cursor[c], F.col(c)
        if v is None:
            return F.lit(False) if descending else col.isNotNull()
        return (col < F.lit(v)) | col.isNull() if descending else col > F.lit(v)

    parts = [reduce(lambda a, b: a & b, (F.col(e).eqNullSafe(F.lit(cursor[e])) for e, _ in by[:i]), F.lit(True)) & beyond(c, d) for i, (c, d) in enumerate(by)]
    return reduce(lambda a, b: a | b, parts)


def page(df: DataFrame, table: Table, sort: Sequence[str] = (), cursor: Mapping[str, Any] | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page; a row beyond the limit tells the caller that more follow."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    by = terms(table, sort)
    if cursor is not None:
        df = df.filter(after(by, cursor))
    return df.orderBy(*order(by)).limit(limit + 1)


def cursor_of(row: Mapping[str, Any], table: Table, sort: Sequence[str] = ()) -> dict[str, Any]:
    return {c: row[c] for c, _ in terms(table, sort)}


def top_k(df: DataFrame, k: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(k)


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact top-k of one query by inner product, in the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.aggregate(F.zip_with(F.transform(vector_col, lambda x: x.cast("double")), q, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Rows that a view of one trace shows: its spans, and each kind of child.
SPANS_SHOWN, CHILDREN_SHOWN = 10_000, 20_000
#: The order of each kind of child.
CHILD_ORDER = {"events": ("time_ns", "sequence"), "documents": ("span_id", "rank"), "steps": ("step_number", "start_ns"), "costs": ("time_ns",)}


def trace_spans(spans: DataFrame, trace_id: Any, limit: int = SPANS_SHOWN) -> DataFrame:
    """A trace's spans by start, then id."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_ns", "span_id").limit(limit)


def children(rows: DataFrame, kind: str, trace_id: Any, span_id: str | None = None, limit: int = CHILDREN_SHOWN) -> DataFrame:
    """A trace's, or a span's, events, documents, steps or costs in order."""
    rows = rows.filter(F.col("trace_id") == trace_id)
    if span_id:
        rows = rows.filter(F.col("span_id") == span_id)
    return rows.orderBy(*CHILD_ORDER[kind]).limit(limit)
