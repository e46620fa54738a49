"""Decoding of OTLP/HTTP JSON trace requests and native batches.

Requests are texts, one row each (``request_id, body``); a row of the result
is a span or a reject.  Nothing is decoded row by row in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{ANY}>>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRS}>"
_LINK = f"struct<traceId:string,spanId:string,attributes:{_ATTRS}>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRS},events:array<{_EVENT}>,links:array<{_LINK}>>"
SCHEMA = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{_SPAN}>>>,instrumentationLibrarySpans:array<struct<spans:array<{_SPAN}>>>>>>"
#: Names that a request may also write with underscores.
NAMES = ("resourceSpans", "scopeSpans", "instrumentationLibrarySpans", "traceId", "spanId", "parentSpanId", "startTimeUnixNano", "endTimeUnixNano", "timeUnixNano", "stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")
#: Events and links of a span that are read, as the format's limits have it.
EVENTS, LINKS = 128, 64
#: The names of span kinds by number.
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")


def decode_id(text: Column, n_bytes: int) -> Column:
    """Lower-case hex of an id given in hex or base64; null if neither."""
    plain = F.trim(text)
    padded = F.rpad(plain, (n_bytes + 2) // 3 * 4, "=")
    raw = F.try_to_binary(F.when(plain.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), padded), F.lit("base64"))
    return F.when(plain.rlike(f"^[0-9a-fA-F]{{{2 * n_bytes}}}$"), F.lower(plain)).when(F.octet_length(raw) == n_bytes, F.lower(F.hex(raw)))


#: Levels of arrays and maps within a span's values, and those of its resource,
#: events and links; what lies deeper stays as it is written.
DEPTH, OTHERS = 1, 0

# Expressions over values are SQL text: as Columns, those of nested values take
# a call into the JVM for each of their hundreds of nodes.


def _let(value: str, name: str, body: str) -> str:
    """The body, in which a name stands for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _quoted(text: str) -> str:
    return rf"regexp_replace(to_json(array({text})), '^\\[|\\]$', '')"


def _scalar(v: str) -> str:
    """A value's kind (s, b, i, d or o) and text, arrays and maps left out."""
    whole = f"cast(try_cast({v}.intValue as bigint) as string)"
    kind = f"case when {v}.stringValue is not null or {v}.bytesValue is not null then 's' when {v}.boolValue is not null then 'b' when {whole} is not null then 'i' when {v}.doubleValue is not null then 'd' else 'o' end"
    return f"named_struct('kind', {kind}, 'text', coalesce({v}.stringValue, cast({v}.boolValue as string), {whole}, cast({v}.doubleValue as string), {v}.bytesValue))"


def _item(v: str, depth: int) -> str:
    """``kind, text``; an array is of kind a, a map a text of its JSON."""
    array, pairs = (f"{v}.arrayValue", f"{v}.kvlistValue") if not depth else (_array_text(f"{v}.arrayValue", depth - 1), _map_text(f"{v}.kvlistValue", depth - 1))
    kind = "a" if depth else "s"
    return f"case when {v}.arrayValue is not null then named_struct('kind', '{kind}', 'text', {array}) when {v}.kvlistValue is not null then named_struct('kind', 's', 'text', {pairs}) else {_scalar(v)} end"


def _array_text(raw: str, depth: int) -> str:
    """A homogeneous array as JSON; another as one of texts."""
    i, items = f"i{depth}", f"items{depth}"
    joined = lambda e: f"concat('[', array_join(transform({items}, {i} -> {e}), ','), ']')"
    named = f"case when {i}.kind = 'b' then initcap({i}.text) when {i}.kind = 'o' then 'None' else {i}.text end"
    text = f"case when forall({items}, {i} -> {i}.kind = 'i') then {joined(f'{i}.text')} when forall({items}, {i} -> {i}.kind in ('i', 'd')) then {joined(f'cast(cast({i}.text as double) as string)')} else {joined(_quoted(named))} end"
    values = f"coalesce(from_json({raw}, 'struct<values:array<{ANY}>>').`values`, cast(array() as array<{ANY}>))"
    return _let(f"transform({values}, x{depth} -> {_item(f'x{depth}', depth)})", items, text)


def _last(pairs: str) -> str:
    """Pairs but for those whose key comes again behind them."""
    return f"filter({pairs}, (p, i) -> not exists(slice({pairs}, i + 2, size({pairs})), q -> q.key = p.key))"


def _map_text(raw: str, depth: int) -> str:
    """A map as a JSON object; of repeated keys the last."""
    pairs, p = f"pairs{depth}", f"p{depth}"
    value = f"case when {p}.item.kind = 's' then {_quoted(f'{p}.item.text')} else {p}.item.text end"
    text = f"concat('{{', array_join(transform({_last(pairs)}, {p} -> concat({_quoted(f'{p}.key')}, ':', {value})), ','), '}}')"
    given = f"coalesce(from_json({raw}, 'struct<values:{_ATTRS}>').`values`, cast(array() as {_ATTRS}))"
    items = f"transform({given}, y{depth} -> named_struct('key', y{depth}.key, 'item', {_item(f'y{depth}.value', depth)}))"
    return _let(f"filter({items}, {p} -> coalesce({p}.key, '') <> '' and {p}.item.kind <> 'o')", pairs, text)


def any_value(v: str, depth: int = DEPTH) -> str:
    """A value as text: a whole number, true or false, a text as it is; arrays
    and maps as JSON of their values, not of how the request wraps them."""
    return f"case when {v}.arrayValue is not null then {_array_text(f'{v}.arrayValue', depth)} when {v}.kvlistValue is not null then {_map_text(f'{v}.kvlistValue', depth)} else {_scalar(v)}.text end"


def attribute_map(attributes: str, depth: int = DEPTH) -> str:
    """The last of repeated keys wins; entries without a key or value go."""
    pairs = f"transform(coalesce({attributes}, cast(array() as {_ATTRS})), a -> named_struct('key', a.key, 'value', {any_value('a.value', depth)}))"
    # few spans repeat a key: only those compare theirs
    made = f"map_from_entries(case when size(array_distinct(transform(good, g -> g.key))) = size(good) then good else {_last('good')} end)"
    return _let(f"filter({pairs}, b -> coalesce(b.key, '') <> '' and b.value is not null)", "good", made)


def camel_case(body: Column) -> Column:
    """A request with the names that this decoder knows.  Only names of JSON
    members are replaced: within a text their quotes are escaped."""
    out = body
    for name in NAMES:
        out = F.regexp_replace(out, '(?<!\\\\)"' + re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name) + r'"\s*:', f'"{name}":')
    return F.when(body.rlike(r'(?<!\\)"resource_spans"\s*:'), out).otherwise(body)


def decode(requests: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """``request_id, index, trace_id, span_id, parent_span_id, name, kind,
    start_ns, end_ns, status, status_message, attributes, resource, events, links,
    reject``: reject names what is wrong with a span (or with a whole request), and the
    other spans of its request stay.  ``keep`` names columns to pass on."""
    # the parse is written down as a column of its own, and each request is
    # exploded once: one that cannot be decoded is a row without a span
    parsed = requests.withColumn("_d", F.from_json(camel_case(F.col(body)), SCHEMA, {"mode": "PERMISSIVE"}))
    none = F.expr(f"cast(array() as array<array<{_SPAN}>>)")
    groups = lambda r: F.concat(F.coalesce(F.transform(r["scopeSpans"], lambda s: s["spans"]), none), F.coalesce(F.transform(r["instrumentationLibrarySpans"], lambda s: s["spans"]), none))
    spans_of = lambda r: F.flatten(F.filter(groups(r), lambda g: g.isNotNull()))
    every = F.flatten(F.transform(F.col("_d.resourceSpans"), lambda r: F.transform(spans_of(r), lambda s: F.struct(r["resource"]["attributes"].alias("res"), s.alias("s")))))
    undecodable = F.array(F.lit(None).cast(f"struct<res:{_ATTRS},s:{_SPAN}>"))
    spans = parsed.select("request_id", *keep, F.posexplode(F.when(F.col("_d.resourceSpans").isNull(), undecodable).otherwise(every)).alias("index", "x"))
    spans = spans.select("request_id", *keep, "index", F.col("x").isNull().alias("_bad"), F.expr(attribute_map("x.res", OTHERS)).alias("resource"), F.col("x.s").alias("s"))
    start, end = F.col("s.startTimeUnixNano").try_cast("long"), F.col("s.endTimeUnixNano").try_cast("long")
    event = f"named_struct('sequence', i, 'name', substring(coalesce(nullif(e.name, ''), 'event'), 1, 512), 'time_ns', try_cast(e.timeUnixNano as bigint), 'attributes', {attribute_map('e.attributes', OTHERS)})"
    events = f"transform(slice(coalesce(s.events, cast(array() as array<{_EVENT}>)), 1, {EVENTS}), (e, i) -> {event})"
    linked = f"transform(slice(coalesce(s.links, cast(array() as array<{_LINK}>)), 1, {LINKS}), l -> named_struct('trace_id', l.traceId, 'span_id', l.spanId, 'attributes', {attribute_map('l.attributes', OTHERS)}))"
    links = F.transform(F.expr(linked), lambda l: F.struct(decode_id(l["trace_id"], 16).alias("trace_id"), decode_id(l["span_id"], 8).alias("span_id"), l["attributes"].alias("attributes")))  # noqa: E741
    out = spans.select(
        "request_id", *keep, "index", "_bad", decode_id(F.col("s.traceId"), 16).alias("trace_id"), decode_id(F.col("s.spanId"), 8).alias("span_id"),
        F.coalesce(decode_id(F.col("s.parentSpanId"), 8), F.lit("")).alias("parent_span_id"), F.coalesce("s.name", F.lit("")).alias("name"),
        F.coalesce(F.try_element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1), F.lit("unspecified")).alias("kind"),
        start.alias("start_ns"), F.when(end > 0, end).alias("end_ns"),
        F.when(F.col("s.status.code").isin("2", "STATUS_CODE_ERROR"), "error").when(F.col("s.status.code").isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset").alias("status"),
        F.coalesce("s.status.message", F.lit("")).alias("status_message"), F.expr(attribute_map("s.attributes")).alias("attributes"), "resource",
        F.expr(events).alias("events"), links.alias("links"),
    )
    return out.withColumn("reject", F.when(F.col("_bad"), "undecodable").otherwise(_reject())).drop("_bad")


def _reject() -> Column:
    return F.when(F.col("trace_id").isNull() | F.col("span_id").isNull(), "invalid_id").when(F.col("start_ns").isNull(), "invalid_time").when(F.col("end_ns") < F.col("start_ns"), "end_before_start")


NATIVE = "struct<resource:struct<service_name:string>,spans:array<struct<trace_id:string,span_id:string,parent_span_id:string,name:string,category:string,start_time_unix_nano:long,end_time_unix_nano:long,status:string,attributes:map<string,string>,usage:map<string,string>,tags:array<string>>>,idempotency_key:string>"


def decode_native(batches: DataFrame, body: str = "body", keep: Sequence[str] = (), prefix: str = "platform.") -> DataFrame:
    """Native batches, with the columns of ``decode`` and ``service_name,
    category, tags``: typed usage, tags and category are lowered to attribute
    keys; attributes that are given explicitly win."""
    parsed = batches.withColumn("_d", F.from_json(body, NATIVE))
    missing = F.array(F.lit(None).cast(parsed.select(F.col("_d.spans")[0].alias("s")).schema["s"].dataType))
    spans = parsed.select("request_id", *keep, F.col("_d.resource.service_name").alias("service_name"), F.posexplode(F.when(F.col("_d.spans").isNull(), missing).otherwise(F.col("_d.spans"))).alias("index", "s"))
    empty = F.expr("cast(map() as map<string,string>)")
    given = F.coalesce("s.attributes", empty)
    lowered = F.transform_keys(F.coalesce("s.usage", empty), lambda k, v: F.concat(F.lit(f"{prefix}usage."), k))
    named = lambda key, v: F.when(v.isNotNull(), F.create_map(F.lit(f"{prefix}{key}"), v)).otherwise(empty)
    lowered = F.map_concat(lowered, named("span.category", F.col("s.category")), named("tags", F.to_json("s.tags")))
    merged = F.map_concat(F.map_filter(lowered, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)
    service = F.col("service_name")
    out = spans.select(
        "request_id", *keep, "index", "service_name", F.lower("s.trace_id").alias("trace_id"), F.lower("s.span_id").alias("span_id"), F.lower(F.coalesce("s.parent_span_id", F.lit(""))).alias("parent_span_id"), F.coalesce("s.name", F.lit("")).alias("name"),
        F.lit("internal").alias("kind"), "s.category", F.col("s.start_time_unix_nano").alias("start_ns"), F.col("s.end_time_unix_nano").alias("end_ns"), F.coalesce("s.status", F.lit("unset")).alias("status"), F.lit("").alias("status_message"),
        merged.alias("attributes"), F.when(service.isNotNull(), F.create_map(F.lit("service.name"), service)).otherwise(empty).alias("resource"),
        F.expr("cast(array() as array<struct<sequence:int,name:string,time_ns:bigint,attributes:map<string,string>>>)").alias("events"), F.expr("cast(array() as array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>)").alias("links"), "s.tags",
        F.when(F.col("s").isNull(), "undecodable").alias("_bad"),
    )
    return out.withColumn("reject", F.coalesce("_bad", _reject())).drop("_bad")
