"""Canonical JSON: one text, and so one hash, for each value; secrets hidden, bounds enforced."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx

#: Bounds of a value: nodes, depth, entries of an array, bytes of its text.
NODES, DEPTH, ENTRIES, BYTES = 10_000, 12, 1_000, 2 * 1024 * 1024
#: Keys whose values are hidden, keys and texts that no value may have.
SENSITIVE = re.compile(
    r"authorization|cookie|token|secret|api[-_]?key|password|credential|session|signature|^sig$|^key$|webhook", re.I
)
SECRET_KEY = re.compile(
    r"authorization|cookie|token|secret|api[-_]?key|password|credential|session|signature|^sig$|^key$", re.I
)
RAW_KEY = re.compile(r"^(?:raw[-_]?html|html|body|response[-_]?body|headers?|cookies?)$", re.I)
RAW_TEXT = re.compile(r"<!doctype\s+html|<html(?:\s|>)", re.I)
DROPPED = frozenset(("__proto__", "prototype", "constructor"))


class Canonical(NamedTuple):
    """A canonical text, or why there is none."""

    text: str | None
    problem: str | None


#: The shapes of :func:`tidemark.functions.text.redact`, for texts that Python holds.
_SECRETS = tuple(
    (re.compile(pattern), by)
    for pattern, by in (
        (tx.BEARER, r"\1 [REDACTED]"),
        (tx.QUERY_SECRET, r"\1[REDACTED]"),
        (tx.WEB_TOKEN, "[REDACTED]"),
        (tx.PREFIXED, "[REDACTED]"),
        (tx.ASSIGNMENT, r"\1=[REDACTED]"),
        (tx.EMAIL, "[REDACTED_EMAIL]"),
    )
)
_PHONE = re.compile(tx.PHONE)
#: Without one of these no secret, address or number can stand in a text.
_SIGNS = re.compile(r"(?i)[=:@]|bearer|basic|eyj|sk|pk|ghp|github_pat|xox|[0-9](?:[ ().-]*[0-9]){9}")


def redact_text(value: str, limit: int = 2_000) -> str:
    """What :func:`tidemark.functions.text.redact` does, for texts that Python holds."""
    value = value if value.isascii() else unicodedata.normalize("NFC", value)
    value = value.replace("\r\n", "\n")
    if _SIGNS.search(value):
        for pattern, by in _SECRETS:
            value = pattern.sub(by, value)
        value = _PHONE.sub(lambda m: "[REDACTED_PHONE]" if tx.is_phone(m.group()) else m.group(), value)
    return value.strip(tx.SPACE_CHARACTERS)[: max(0, min(limit, tx.MAX_TEXT))]


def number_text(value: float) -> str:
    """Shortest text of a double: no point for whole numbers, no sign for zero."""
    if value == 0:
        return "0"
    if float(value).is_integer() and abs(value) < 1e21:
        return str(int(value))
    out = repr(float(value))
    mantissa, e, exponent = out.partition("e")
    if not e:
        return out
    power = int(exponent)
    digits = mantissa.replace(".", "").replace("-", "")
    if -7 <= power < 0:
        return ("-" if value < 0 else "") + "0." + "0" * (-power - 1) + digits
    return f"{mantissa}e{power:+d}"


class Part(NamedTuple):
    """A written piece of a value with what its bounds need: how many values, how deep, what is wrong."""

    text: str
    values: int = 1
    height: int = 0
    wrong: frozenset[str] = frozenset()


_HIDDEN = Part('"[REDACTED]"')
_FINE: frozenset[str] = frozenset()


def _leaf(value) -> Part:
    if isinstance(value, Part):
        return value
    if isinstance(value, str):
        return Part(json.dumps(redact_text(value, tx.MAX_TEXT), ensure_ascii=False), wrong=frozenset({"raw document"}) if RAW_TEXT.search(value) else _FINE)
    if isinstance(value, float):
        return Part(number_text(value)) if math.isfinite(value) else Part("null", wrong=frozenset({"number is not finite"}))
    if isinstance(value, list):
        return _joined("[]", [("", _leaf(v)) for v in value], len(value) > ENTRIES and "array is too long")
    return Part(json.dumps(value))


def _joined(brackets: str, parts: list[tuple[str, Part]], wrong: str | bool = False) -> Part:
    own = frozenset({wrong}) if wrong else _FINE
    return Part(
        brackets[0] + ",".join(name + part.text for name, part in parts) + brackets[1],
        1 + sum(part.values for _, part in parts),
        1 + max((part.height for _, part in parts), default=-1),
        own.union(*(part.wrong for _, part in parts)),
    )


def _object(pairs: list[tuple[str, object]]) -> Part:
    """An object of a JSON text, as soon as the parser has read its last pair."""
    last = {key: value for key, value in pairs if key not in DROPPED}
    made = []
    for key in sorted(last, key=lambda k: k.encode("utf-16-be")):
        part = _HIDDEN if SENSITIVE.search(key) else _leaf(last[key])
        if RAW_KEY.search(key):
            part = Part("null", wrong=frozenset({"raw document"}))
        made.append((json.dumps(key, ensure_ascii=False) + ":", part))
    return _joined("{}", made)


_READER = json.JSONDecoder(object_pairs_hook=_object, parse_int=float, parse_constant=float)


def canonical(text: str | None) -> Canonical:
    """Canonical text of a JSON text; null of null.

    The parser hands over each object when it is complete, so values are written from the leaves
    up, and the bounds are those of the whole: counts and heights add up along the way.
    """
    if text is None:
        return Canonical(None, None)
    try:
        whole = _leaf(_READER.decode(text))
    except (ValueError, RecursionError, OverflowError):
        return Canonical(None, "no JSON")
    found = {
        **dict.fromkeys(sorted(whole.wrong), True),
        "too many values": whole.values > NODES,
        "too deep": whole.height > DEPTH,
        "too large": len(whole.text.encode()) > BYTES,
    }
    problem = next((name for name, is_so in found.items() if is_so), None)
    return Canonical(None if problem else whole.text, problem)


#: JSON texts that are canonical as they are: words of letters that hold no secret, and constants.
PLAIN = r'^(?:"[A-Za-z_]{1,13}(?: [A-Za-z_]{1,13}){0,20}"|true|false|null)$'
PLAIN_NOT = r"(?i)\b(?:bearer|basic)\b"
WHOLE = r"^-?[1-9][0-9]{0,14}$|^0$"


def canonical_column(col: Column) -> Column:
    """Struct (text, problem, hash) of a JSON column.

    Constants, whole numbers and plain words are canonical as they stand; only other values go
    through Python.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "problem")])

    def batch(texts: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(texts)
        made = [*(canonical(t) for t in distinct), Canonical(None, None)]
        return pd.DataFrame([made[c] for c in codes], columns=["text", "problem"], dtype=object)

    plain = (col.rlike(PLAIN) & ~col.rlike(PLAIN_NOT)) | col.rlike(WHOLE)
    made = F.pandas_udf(batch, schema)(F.when(~plain, col))
    text = F.when(plain, col).otherwise(made["text"])
    return F.struct(text.alias("text"), made["problem"].alias("problem"), F.sha2(text, 256).alias("hash"))


#: Bounds of a hidden value: levels, entries of an array, keys of an object, characters of a key.
HIDDEN_LEVELS, HIDDEN_ENTRIES, HIDDEN_KEYS, HIDDEN_KEY = 8, 200, 500, 128
TOO_DEEP = "[TRUNCATED_DEPTH]"


def _hidden_leaf(value):
    if isinstance(value, list):
        return list(map(_hidden_leaf, value[:HIDDEN_ENTRIES]))
    return redact_text(value) if isinstance(value, str) else value


def _hidden_object(pairs: list[tuple[str, object]]) -> dict:
    kept = [(k, v) for k, v in pairs if k not in DROPPED][:HIDDEN_KEYS]
    return {redact_text(k, HIDDEN_KEY): "[REDACTED]" if SECRET_KEY.search(k) else _hidden_leaf(v) for k, v in kept}


_HIDER = json.JSONDecoder(object_pairs_hook=_hidden_object)


def hidden(text: str | None) -> str | None:
    """JSON text with secrets hidden, by key and by form; null for null and for text that is no JSON.

    Objects are hidden as the parser completes them; what lies below the last level is cut after.
    """
    try:
        value = None if text is None else _hidden_leaf(_HIDER.decode(text))
    except (ValueError, RecursionError):
        return None
    containers = [value] if isinstance(value, (dict, list)) else []
    for _ in range(HIDDEN_LEVELS):
        entries = [e for c in containers for e in (c.values() if isinstance(c, dict) else c)]
        containers = [e for e in entries if isinstance(e, (dict, list))]
    for c in containers:
        for place in list(c) if isinstance(c, dict) else range(len(c)):
            c[place] = TOO_DEEP
    return None if text is None else json.dumps(value, ensure_ascii=False)


def hidden_column(col: Column) -> Column:
    """:func:`hidden` of a JSON column; equal texts of a batch are read once."""

    def batch(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        made = [*map(hidden, distinct), None]
        return pd.Series([made[c] for c in codes], index=texts.index, dtype=object)

    return F.pandas_udf(batch, T.StringType())(col)


HEX_HASH = "^[0-9a-f]{64}$"


def is_hash(col: Column) -> Column:
    """Whether a text is a SHA-256 hash in lower-case hex; null of null."""
    return col.rlike(HEX_HASH)


def json_string(col: Column) -> Column:
    """JSON text of a string, with all control characters escaped; null of null."""
    made = F.to_json(F.struct(col.alias("v")))
    return F.when(col.isNotNull(), F.substring(made, 6, 2_000_000_000).substr(F.lit(1), F.length(made) - 6))


def manifest_key(identity: Column, candidate: Column | None = None) -> Column:
    """Key under which a target's trusted manifest is stored, or one of its candidates."""
    if candidate is None:
        return F.concat(F.lit("trusted-baseline-v1-manifest-"), identity)
    return F.concat(F.lit("candidate-baseline-v1-manifest-"), identity, F.lit("-"), F.substring(F.sha2(candidate, 256), 1, 24))


def weekly_key(destination: Column, zone: Column, day: Column) -> Column:
    """Key of a destination's weekly state in a zone and for a weekday."""
    body = F.concat(
        F.lit('{"destinationHash":'), json_string(destination), F.lit(',"timezone":'), json_string(zone), F.lit(',"deliveryDay":'), day.cast("string"), F.lit("}")
    )
    return F.concat(F.lit("weekly-digest-v1-"), F.substring(F.sha2(body, 256), 1, 40))


def candidate_name(made_at: Column, ident: Column) -> Column:
    """Id of a candidate from the time it was made and a random id."""
    stamp = F.substring(F.regexp_replace(made_at, "[^0-9]", ""), 1, 14)
    safe = F.substring(F.regexp_replace(ident, "[^A-Za-z0-9_-]", ""), 1, 24)
    return F.concat(F.lit("candidate-"), stamp, F.lit("-"), safe)
