"""Redaction of sensitive keys and values, as Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[redacted]"
CUT, CUT_MARK = 16_384, "…[truncated]"
#: Fragments of sensitive keys and patterns of sensitive values.
KEY_PARTS = ("password", "passwd", "secret", "token", "authorization", "authentication", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "credential", "cookie", "signature", "ssn", "social_security", "credit_card", "card_number", "cvv", "bearer")
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "bearer_token": r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]{20,}=*",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
#: Registered keys that have one of these fragments and hold no
#: secret, and registered keys whose values are a user's own.  Those without a
#: dot of their own namespace stand behind the platform's prefix.
OPEN_KEYS = ("gen_ai.request.max_tokens", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens")
OPEN_OWN = ("usage.input_tokens", "usage.output_tokens", "usage.total_tokens", "usage.cached_input_tokens", "usage.cache_write_tokens", "usage.reasoning_tokens", "latency.time_to_first_token_ms", "retrieval.context_tokens")
CLOSED_KEYS = ("url.full", "db.query.text", "exception.message", "exception.stacktrace")
CLOSED_OWN = ("prompt.variables", "input.value", "output.value", "retrieval.query", "retrieval.rewritten_query", "retrieval.documents", "agent.goal", "agent.decision_summary", "agent.tool.arguments")
PREFIX, DEEPEST, LISTED = "platform.", 8, 64
CARD = r"\b(?:\d[ -]*?){13,19}\b"
#: What a text has at least if a detector finds something in it.
HINTS = {"private_key": "-----BEGIN", "aws_access_key": "AKIA|ASIA", "bearer_token": "(?i:bearer)", "jwt": "eyJ", "email": "@", "credit_card": r"\d(?:[ -]*\d){12}"}
DEFAULT = ("private_key", "aws_access_key", "bearer_token", "jwt", "credit_card")


@dataclass(frozen=True)
class Policy:
    """mode off, standard or strict; with ``allow``, other keys go; ``block``
    keys are marked; ``parts`` are fragments of sensitive keys."""

    mode: str = "standard"
    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    parts: tuple[str, ...] = KEY_PARTS
    detectors: tuple[str, ...] = DEFAULT
    longest: int = CUT
    prefix: str = PREFIX

    def merged(self, own: dict[str, Any] | None) -> Policy:
        """With a project's own settings, which can only tighten the mode, the
        blocked keys, the fragments and the length; lists of allowed keys and
        of detectors stand in the place of these."""
        if not own:
            return self
        order = ("off", "standard", "strict")
        mode = own.get("mode") if own.get("mode") in order[order.index(self.mode) :] else self.mode
        return replace(
            self,
            mode=mode,
            allow=tuple(own.get("allow", self.allow)),
            block=tuple(dict.fromkeys((*self.block, *own.get("block", ())))),
            parts=(*self.parts, *own.get("parts", ())),
            detectors=tuple(own.get("detectors", self.detectors)),
            longest=min(int(own.get("longest", self.longest)), self.longest),
        )

    def keys(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Registered keys: open and closed ones."""
        return tuple([*OPEN_KEYS, *(self.prefix + k for k in OPEN_OWN)]), tuple([*CLOSED_KEYS, *(self.prefix + k for k in CLOSED_OWN)])


def sensitive_key(key: Column, policy: Policy = Policy()) -> Column:
    """A registered key is judged by what it was declared as, or if blocked;
    fragments only tell of keys that are not registered."""
    name = F.lower(key)
    free, closed = policy.keys()
    out = name.rlike("|".join(re.escape(p.lower()) for p in policy.parts)) if policy.parts else F.lit(False)
    out = F.when(key.isin(*free), F.lit(False)).when(key.isin(*closed), F.lit(True)).otherwise(out)
    return out | name.isin(*policy.block) if policy.block else out


def cards(text: Column) -> Column:
    """The digit runs of a text that pass the Luhn check."""
    runs = F.regexp_extract_all(text, F.lit(f"({CARD})"), 1)
    return F.filter(runs, lambda r: F.call_function("luhn_check", F.regexp_replace(r, r"\D", "")))


def value(text: Column, detectors: Sequence[str] = DEFAULT) -> Column:
    """Each detected value replaced by the mark.  Few texts have any: one search
    for what all of the patterns need tells the others apart."""
    hint = "|".join(h for n, h in HINTS.items() if n in detectors)
    return F.when(text.rlike(hint), _marked(text, detectors)).otherwise(text) if hint else text


def _marked(text: Column, detectors: Sequence[str]) -> Column:
    for name, pattern in PATTERNS.items():
        if name in detectors:
            text = F.regexp_replace(text, pattern, MARK)
    if "credit_card" in detectors:
        text = F.aggregate(cards(text), text, lambda a, c: F.replace(a, c, F.lit(MARK)))
    return text


def truncated(text: Column, limit: int = CUT) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(CUT_MARK))).otherwise(text)


def _nested(policy: Policy) -> Callable[[Column], Column]:
    """Values that are JSON objects or arrays, walked key by key; few are."""
    free, closed = policy.keys()
    patterns = [re.compile(PATTERNS[n]) for n in PATTERNS if n in policy.detectors]
    card = re.compile(CARD) if "credit_card" in policy.detectors else None

    def luhn(digits: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def secret(key: str) -> bool:
        if key in free or key in closed:
            return key in closed or key.lower() in policy.block
        return key.lower() in policy.block or any(p.lower() in key.lower() for p in policy.parts)

    def clean(v: Any, depth: int) -> Any:
        if depth > DEEPEST:
            return MARK
        if isinstance(v, dict):
            return {k: MARK if secret(k) else clean(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x, depth + 1) for x in v]
        if isinstance(v, str):
            for p in patterns:
                v = p.sub(MARK, v)
            if card:
                v = card.sub(lambda m: MARK if luhn(re.sub(r"\D", "", m[0])) else m[0], v)
            return v if len(v) <= policy.longest else v[: policy.longest] + CUT_MARK
        return v

    def walked(m: dict[str, str] | None) -> dict[str, str]:
        out = {}
        for k, v in dict(m or {}).items():
            try:
                out[k] = json.dumps(clean(json.loads(v), 0), ensure_ascii=False)
            except (ValueError, RecursionError):  # text that only begins like JSON
                out[k] = clean(v, 0)
        return out

    def run(maps: pd.Series) -> pd.Series:
        return maps.map(walked)

    return F.pandas_udf(run, "map<string,string>")


def attributes(m: Column, policy: Policy = Policy()) -> Column:
    """A map by policy: with allowed keys, others go; sensitive keys' values
    are marked, other values redacted and cut; values that are JSON objects or
    arrays are walked, eight levels deep."""
    if policy.mode == "off":
        return m
    if policy.allow:
        m = F.map_filter(m, lambda k, v: k.isin(*policy.allow))
    # told once for each key, by the value as it came
    walks = lambda k, v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)) & ~sensitive_key(k, policy)
    deep = F.map_filter(m, walks)
    flat = F.map_filter(m, lambda k, v: ~walks(k, v))
    flat = F.transform_values(flat, lambda k, v: F.when(sensitive_key(k, policy), F.lit(MARK)).otherwise(truncated(value(v, policy.detectors), policy.longest)))
    return F.map_concat(flat, _nested(policy)(deep))


def redacted_keys(before: Column, after: Column) -> Column:
    """The keys whose values went or were marked, in order, 64 at most."""
    gone = F.map_filter(before, lambda k, v: ~F.coalesce(F.try_element_at(after, k), F.lit("")).eqNullSafe(F.coalesce(v, F.lit(""))))
    return F.slice(F.array_sort(F.map_keys(gone)), 1, LISTED)


def headers(m: Column, policy: Policy = Policy()) -> Column:
    """Values of sensitive headers marked, others as they are."""
    return F.transform_values(m, lambda k, v: F.when(sensitive_key(k, policy), F.lit(MARK)).otherwise(v))


def payload(text: Column, policy: Policy = Policy()) -> Column:
    """Null in strict mode, else redacted and cut."""
    if policy.mode == "off":
        return text
    return F.lit(None).cast("string") if policy.mode == "strict" else truncated(value(text, policy.detectors), policy.longest)


def url(text: Column) -> Column:
    """Without user information, values of sensitive parameters or fragment."""
    bare = F.regexp_replace(F.regexp_replace(text, r"#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?@]*@", f"$1{MARK.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}@")
    names = "|".join(p.replace("-", r"\-") for p in KEY_PARTS)
    return F.regexp_replace(bare, rf"(?i)([?&][^=&]*(?:{names})[^=&]*)=[^&]*", "$1=%5Bredacted%5D")
