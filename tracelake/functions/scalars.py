"""Scalar functions of the telemetry model, as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Span categories, and the plausible range of event times
#: (2000 to 2100, Unix nanoseconds).
CATEGORIES = ("llm_generation", "chat_completion", "embedding", "retrieval", "rerank", "prompt_render", "guardrail", "tool_call", "agent_decision", "agent_handoff", "workflow_step", "db_query", "http_request", "queue_operation", "custom")
PLAUSIBLE = (946_684_800 * 10**9, 4_102_444_800 * 10**9)
#: Fixed value: Crockford's base-32 alphabet.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Fragments that tell a model's provider, in order.
PROVIDER_HINTS = {
    "openai": ("gpt", "o1", "o3", "o4", "text-embedding", "davinci", "babbage"),
    "anthropic": ("claude", "opus", "sonnet", "haiku"),
    "bedrock": ("bedrock", "amazon.", "anthropic.claude-", "meta.llama", "mistral."),
    "mock": ("mock", "fixture", "deterministic"),
}


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def timestamp_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def plausible_ns(ns: Column) -> Column:
    return ns.between(*PLAUSIBLE)


def parse_ns(text: Column) -> Column:
    """Integer nanoseconds, seconds (below 1e12) or an RFC 3339 time."""
    number = text.try_cast("double")
    whole = text.try_cast("long")
    stamp = F.unix_micros(F.try_to_timestamp(text)) * 1000
    return F.when(number.isNotNull() & (F.abs(number) < 1e12), (number * 1e9).cast("long")).when(whole.isNotNull(), whole).otherwise(stamp)


def duration_ns(start: Column, end: Column) -> Column:
    """Null while the span is open."""
    return end - start


def ns_to_ms(ns: Column) -> Column:
    return ns / 1e6


def coerce_category(text: Column) -> Column:
    name = F.translate(F.lower(F.trim(text)), "- ", "__")
    return F.when(name.isin(*CATEGORIES), name).otherwise("custom")


def infer_category(attributes: Column, prefix: str = "platform.") -> Column:
    """From the attributes a span has: its own category, else the operation's
    name, else the first tell-tale key."""
    get = lambda k: F.try_element_at(attributes, F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key(attributes, k), F.lit(False))
    own = coerce_category(get(f"{prefix}span.category"))
    op = F.lower(F.coalesce(get("gen_ai.operation.name"), F.lit("")))
    rules = [
        (own != "custom", own),
        (op.isin("chat", "chat.completions", "generate_content"), "chat_completion"),
        (op.isin("embeddings", "embedding"), "embedding"),
        (op.isin("text_completion", "completion"), "llm_generation"),
        ((op == "execute_tool") | has("gen_ai.tool.name"), "tool_call"),
        (has(f"{prefix}retrieval.query") | has(f"{prefix}retrieval.documents"), "retrieval"),
        (has(f"{prefix}retrieval.reranker_model"), "rerank"),
        (has(f"{prefix}agent.step_number"), "agent_decision"),
        (has(f"{prefix}guardrail.name"), "guardrail"),
        (has("gen_ai.request.model"), "llm_generation"),
        (has("db.system"), "db_query"),
        (has("http.request.method"), "http_request"),
        (has("messaging.system"), "queue_operation"),
    ]
    out = F.when(*rules[0])
    for test, name in rules[1:]:
        out = out.when(test, F.lit(name))
    return out.otherwise("custom")


def estimate_tokens(text: Column) -> Column:
    """A token for 3.8 characters, one at least; null for no text."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 3.8).cast("long")))


def usage(attributes: Column, name: str, prefix: str = "platform.") -> Column:
    """The platform's key wins by presence over the standard one."""
    own, standard = f"{prefix}usage.{name}", f"gen_ai.usage.{name}"
    pick = F.when(F.map_contains_key(attributes, own), F.try_element_at(attributes, F.lit(own))).otherwise(F.try_element_at(attributes, F.lit(standard)))
    return pick.try_cast("long")


def total_tokens(total: Column, in_: Column, out: Column) -> Column:
    """The reported total, else the sum of what is known."""
    return F.coalesce(total, in_ + out, in_, out)


def billable_input(in_: Column, cached: Column, convention: Column) -> Column:
    """Cached tokens are taken off where the input includes them."""
    return F.when((convention == "inclusive") & (F.coalesce(cached, F.lit(0)) > 0), F.greatest(in_ - cached, F.lit(0))).otherwise(in_)


def provider_of(model: Column) -> Column:
    name = F.lower(model)
    out = None
    for provider, hints in PROVIDER_HINTS.items():
        test = reduce(lambda a, b: a | b, (name.contains(h) for h in hints))
        out = F.when(test, provider) if out is None else out.when(test, provider)
    return out


def model_family(model: Column) -> Column:
    """The first hint of the model's provider that its name holds."""
    name = F.lower(model)
    out = F.lit(None).cast("string")
    for hints in reversed(PROVIDER_HINTS.values()):
        family = F.lit(None).cast("string")
        for h in reversed(hints):
            family = F.when(name.contains(h), h).otherwise(family)
        out = F.when(reduce(lambda a, b: a | b, (name.contains(h) for h in hints)), family).otherwise(out)
    return out


def partition_of(key: Column, partitions: int = 8) -> Column:
    """Where a key goes on the bus: its bytes in base 131, modulo 2^32."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(F.encode(key, "UTF-8"), i, 1)), 16, 10).cast("long"))
    bytes_ = F.when(F.octet_length(key) > 0, codes).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(bytes_, F.lit(0).cast("long"), lambda h, b: (h * 131 + b) % (1 << 32)) % partitions


def ulid(prefix: str, ms: Column, seed: Column) -> Column:
    """A prefixed id that sorts by time: 48 bits of milliseconds and 80 of a
    hash of ``seed``, in base 32 (ten digits and sixteen)."""
    digit = lambda n: F.substring(F.lit(BASE32), n.cast("int") + 1, 1)
    time = [digit(F.shiftrightunsigned(ms, 5 * k).bitwiseAND(F.lit(31))) for k in range(9, -1, -1)]
    halves = [F.conv(F.substring(F.sha2(seed, 256), at, 10), 16, 10).cast("long") for at in (1, 11)]
    rest = [digit(F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31))) for h in halves for k in range(7, -1, -1)]
    return F.concat(F.lit(f"{prefix}_"), *time, *rest)


def canonical_model(model: Column) -> Column:
    """Without a region prefix."""
    return F.regexp_replace(model, r"^(?:us-gov|us|eu|apac)\.", "")


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def without_keys(attributes: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(attributes, lambda k, v: ~k.isin(*keys))


def bounded(array: Column, n: int = 64) -> Column:
    return F.slice(array, 1, n)


def delta(left: Column, right: Column) -> tuple[Column, Column]:
    """Absolute and relative change; relative is null from null or zero."""
    return right - left, F.when(left != 0, (right - left) / left)


def sampled(trace_id: Column, share: float) -> Column:
    """Head sampling: all spans of a trace or none, always the same traces."""
    return F.pmod(F.xxhash64(trace_id), F.lit(10_000)) < int(share * 10_000)


def content_hash(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def span_identity(org: Column, project: Column, trace: Column, span: Column, start: Column, end: Column, name: Column, status: Column) -> Column:
    """Canonical JSON of what makes two deliveries one span, keys in order.
    Quotes and backslashes in names are escaped by to_json."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    parts = [("end", number(end)), ("name", quoted(name)), ("organization_id", quoted(org)), ("project_id", quoted(project)), ("span_id", quoted(span)), ("start", number(start)), ("status", quoted(status)), ("trace_id", quoted(trace))]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts)), F.lit("}"))


#: Usage sources from weakest to strongest.
SOURCES = ("missing", "estimated", "client", "provider")


def merged_usage(a: Column, b: Column, a_source: Column, b_source: Column) -> Column:
    """Of two reports the one of better provenance; of equal ones the first,
    its gaps filled from the second."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, SOURCES)), s)
    return F.when(rank(a_source) > rank(b_source), a).when(rank(a_source) < rank(b_source), b).otherwise(F.coalesce(a, b))


def provider_usage(provider: Column, raw: Column) -> Column:
    """A provider's raw usage JSON as a struct of canonical token counts."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(raw, f"$.{p}").try_cast("long") for p in paths))
    inclusive = provider == "openai"
    return F.struct(
        F.when(inclusive, get("prompt_tokens")).when(provider == "bedrock", get("inputTokens")).otherwise(get("input_tokens")).alias("input_tokens"),
        F.when(inclusive, get("completion_tokens")).when(provider == "bedrock", get("outputTokens")).otherwise(get("output_tokens")).alias("output_tokens"),
        F.when(inclusive, get("prompt_tokens_details.cached_tokens")).otherwise(get("cache_read_input_tokens", "cacheReadInputTokens")).alias("cached_input_tokens"),
        F.when(inclusive, "inclusive").otherwise("exclusive").alias("cache_convention"),
    )


def format_cost(amount: Column, currency: Column) -> Column:
    """Six places, half to even."""
    return F.concat(F.bround(amount.cast("decimal(26,12)"), 6).cast("decimal(26,6)").cast("string"), F.lit(" "), currency)


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.2fs", ms / 1000)).otherwise(F.concat(F.floor(ms / 60_000), F.lit("m "), F.floor(ms % 60_000 / 1000), F.lit("s")))
