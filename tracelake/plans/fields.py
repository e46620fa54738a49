"""The logical fields of each telemetry table.

Users name logical fields; each has a kind, a physical column and, for
durations, a unit.  Only registered fields can be filtered, sorted or grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

STRING, ENUM, INTEGER, NUMBER, BOOLEAN, TIMESTAMP, ARRAY, MAP = "string", "enum", "integer", "number", "boolean", "timestamp", "array", "map"

_ORDER = ("gt", "gte", "lt", "lte", "between")
_NULLS = ("is_null", "is_not_null")
#: Operators for each kind.
OPERATORS = {
    STRING: ("eq", "ne", "in", "not_in", "contains", "starts_with", "ends_with", *_NULLS),
    ENUM: ("eq", "ne", "in", "not_in", *_NULLS),
    INTEGER: ("eq", "ne", "in", "not_in", *_ORDER, *_NULLS),
    NUMBER: ("eq", "ne", *_ORDER, *_NULLS),
    BOOLEAN: ("eq", "ne", *_NULLS),
    TIMESTAMP: ("eq", *_ORDER),
    ARRAY: ("has", "has_any", "has_all", *_NULLS),
    MAP: (),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    column: str = ""
    scale: int = 1
    """What a value is multiplied by: 1,000,000 for milliseconds in ns."""
    sortable: bool = False
    values: tuple[str, ...] = ()

    @property
    def physical(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    time: str
    """The event-time column, Unix nanoseconds."""
    tiebreak: str
    sort: tuple[str, ...] = ("-start_time",)
    text: tuple[str, ...] = ()
    """Columns that a text query compares with; the first by containment."""

    def field(self, name: str) -> Field:
        found = {f.name: f for f in self.fields}
        if name in found:
            return found[name]
        head, _, key = name.partition(".")
        if key and head in found and found[head].kind == MAP:
            return Field(name, STRING, name)
        raise ValueError(f"unknown field {name!r}; known: {', '.join(sorted(found))}")


def _f(name: str, kind: str, column: str = "", scale: int = 1, sortable: bool = False, values: tuple[str, ...] = ()) -> Field:
    return Field(name, kind, column, scale, sortable, values)


STATUSES = ("ok", "error", "unset")
SPANS = Table(
    "spans",
    (
        _f("trace_id", STRING, sortable=True), _f("span_id", STRING, sortable=True), _f("parent_span_id", STRING), _f("name", STRING, sortable=True),
        _f("category", ENUM, sortable=True), _f("kind", ENUM), _f("status", ENUM, sortable=True, values=STATUSES),
        _f("start_time", TIMESTAMP, "start_ns", sortable=True), _f("end_time", TIMESTAMP, "end_ns", sortable=True),
        _f("duration_ms", NUMBER, "duration_ns", 1_000_000, True), _f("service", STRING, "service_name"),
        _f("session_id", STRING), _f("subject_id", STRING), _f("release", STRING), _f("git_commit", STRING), _f("environment", ENUM),
        _f("provider", STRING), _f("model", STRING, sortable=True), _f("prompt_version_id", STRING),
        _f("input_tokens", INTEGER, sortable=True), _f("output_tokens", INTEGER, sortable=True), _f("total_tokens", INTEGER, sortable=True),
        _f("cost", NUMBER, "cost_total", sortable=True), _f("cost_status", ENUM, "cost_estimation_status"),
        _f("error_type", STRING), _f("tool_name", STRING), _f("agent_id", STRING), _f("retriever_name", STRING),
        _f("late_arrival", BOOLEAN), _f("tags", ARRAY), _f("attributes", MAP),
    ),
    "start_ns", "span_id", text=("name", "trace_id", "session_id"),
)
TRACES = Table(
    "traces",
    (
        _f("trace_id", STRING, sortable=True), _f("name", STRING, sortable=True), _f("status", ENUM, sortable=True, values=("ok", "error", "incomplete")),
        _f("start_time", TIMESTAMP, "start_ns", sortable=True), _f("duration_ms", NUMBER, "duration_ns", 1_000_000, True),
        _f("span_count", INTEGER, sortable=True), _f("error_count", INTEGER, sortable=True), _f("session_id", STRING),
        _f("input_tokens", INTEGER, "total_input_tokens", sortable=True), _f("output_tokens", INTEGER, "total_output_tokens", sortable=True),
        _f("cost", NUMBER, "total_cost", sortable=True), _f("cost_status", ENUM, "cost_estimation_status"),
        _f("model", ARRAY, "models"), _f("tags", ARRAY),
    ),
    "start_ns", "trace_id", text=("name", "trace_id", "session_id"),
)
DOCUMENTS = Table("retrieval_documents", (_f("document_id", STRING), _f("rank", INTEGER, sortable=True), _f("score", NUMBER, sortable=True), _f("rerank_rank", INTEGER, sortable=True), _f("source", STRING), _f("retriever_name", STRING)), "time_ns", "document_id", ("rank",))
STEPS = Table("agent_steps", (_f("agent_id", STRING), _f("step_number", INTEGER, sortable=True), _f("step_type", ENUM), _f("tool_name", STRING), _f("status", ENUM), _f("duration_ms", NUMBER, "duration_ns", 1_000_000, True)), "start_ns", "span_id", ("step_number",))
COSTS = Table("cost_records", (_f("model", STRING), _f("provider", STRING), _f("start_time", TIMESTAMP, "time_ns", sortable=True), _f("total", NUMBER, sortable=True), _f("currency", ENUM)), "time_ns", "span_id")
TABLES = {t.name: t for t in (SPANS, TRACES, DOCUMENTS, STEPS, COSTS)}
