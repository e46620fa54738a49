"""Canonical JSON (RFC 8785) and identifiers derived from it."""

from __future__ import annotations

import json
import math
import unicodedata
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 64
#: Fixed value: Crockford's base-32 alphabet.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def number(x: float | int) -> str:
    """As ECMAScript writes a number."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, e, exponent = repr(x).partition("e")
    if not e:
        return mantissa
    power = int(exponent)
    if -6 <= power < 0:
        return format(Decimal(repr(x)), "f")
    return f"{mantissa.removesuffix('.0')}e{power:+d}"


def canonical(value: Any, depth: int = 0) -> str:
    """Keys by UTF-16 code unit, text in NFC, no white space."""
    if depth > MAX_DEPTH:
        raise ValueError(f"deeper than {MAX_DEPTH} levels")
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, list | tuple):
        return f"[{','.join(canonical(v, depth + 1) for v in value)}]"
    if isinstance(value, dict):
        named = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
        if len(named) < len(value):
            raise ValueError("keys collide after normalisation")
        keys = sorted(named, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(named[k], depth + 1)}" for k in keys) + "}"
    raise TypeError(f"{type(value).__name__} has no JSON form")


def _text(text: str | None) -> str | None:
    try:
        return None if text is None else canonical(json.loads(text))
    except (ValueError, TypeError, RecursionError):
        return None


def canonical_json(text: Column | str) -> Column:
    """The canonical form of JSON texts; null for what isn't JSON."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_text, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def version_id(prefix: str, digest: str) -> str:
    """26 base-32 digits of a hash's first 128 bits."""
    n, out = int(digest.removeprefix("sha256:")[:32], 16), []
    for _ in range(26):
        n, r = divmod(n, 32)
        out.append(BASE32[r])
    return f"{prefix}_{''.join(reversed(out))}"


def version_ids(prefix: str, digest: Column | str) -> Column:
    def run(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: version_id(prefix, d), na_action="ignore")

    return F.pandas_udf(run, "string")(digest)
