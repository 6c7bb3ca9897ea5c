"""URL functions for absolute URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import redact, redact_emails, redact_secrets

#: Query keys that change by themselves, keys whose values are secret, and keys
#: that no monitored URL may have.
VOLATILE_KEY = r"(?i)^(?:utm_.+|gclid|fbclid|msclkid|cache(?:buster)?|cb|_|timestamp|ts|session(?:id)?)$"
SENSITIVE_KEY = (
    r"(?i)authorization|cookie|token|secret|api[-_]?key|password|credential|session|signature|^sig$|^key$"
)
CREDENTIAL_KEY = (
    r"(?i)^(?:auth|authorization|cookie|token|access_token|secret|api[-_]?key|password|credential|session"
    r"|signature|sig|key)$"
)
#: Longest URL that is read.
MAX_URL = 2_048

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(col: Column, name: str) -> Column:
    """scheme, user, host, port, path, query or fragment; null if the URL has none."""
    index = ("scheme", "user", "host", "port", "path", "query", "fragment").index(name) + 1
    text = F.nullif(F.regexp_extract(col, _PARTS, index), F.lit(""))
    return F.lower(text) if name in ("scheme", "host") else text


def pairs(col: Column) -> Column:
    """The query's key=value texts as an array; empty if it has none."""
    query = F.coalesce(part(col, "query"), F.lit(""))
    return F.filter(F.split(query, "&"), lambda p: p != "")


def key_of(pair: Column) -> Column:
    return F.regexp_extract(pair, "^([^=]*)", 1)


def _rebuilt(col: Column, query: Column) -> Column:
    port = part(col, "port")
    scheme = part(col, "scheme")
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.concat(
        scheme,
        F.lit("://"),
        part(col, "host"),
        F.when(port.isNull() | usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.coalesce(part(col, "path"), F.lit("/")),
        F.when(F.size(query) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(query, "&"))),
    )


def _safe_pair(pair: Column) -> Column:
    """A key=value text with the value hidden if its key is secret, else without secrets in the value."""
    value = redact_emails(redact_secrets(F.regexp_extract(pair, "^[^=]*=?(.*)$", 1)))
    shown = F.replace(F.replace(value, F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D"))
    plain = F.when(F.instr(pair, "=") > 0, F.concat(key_of(pair), F.lit("="), shown)).otherwise(pair)
    return F.when(key_of(pair).rlike(SENSITIVE_KEY), F.concat(key_of(pair), F.lit("=%5BREDACTED%5D"))).otherwise(plain)


def canonical(col: Column) -> Column:
    """Without credentials, fragment and volatile keys; keys sorted, equal keys in their order.

    Text that is no absolute URL is redacted instead.
    """
    kept = F.filter(pairs(col), lambda p: ~key_of(p).rlike(VOLATILE_KEY))
    keyed = F.transform(kept, lambda p, i: F.struct(key_of(p).alias("k"), i.alias("i"), p.alias("p")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["p"])
    hidden = F.transform(ordered, _safe_pair)
    return F.when(part(col, "host").isNotNull(), _rebuilt(col, hidden)).otherwise(redact(col, MAX_URL))


def redact_url(col: Column) -> Column:
    """Without credentials and fragment; values of sensitive keys hidden, keys in their order."""
    hidden = F.transform(pairs(col), _safe_pair)
    return F.when(part(col, "host").isNotNull(), _rebuilt(col, hidden)).otherwise(redact(col, MAX_URL))


def sorted_url(col: Column) -> Column:
    """:func:`redact_url` with the keys sorted, equal keys in their order."""
    keyed = F.transform(pairs(col), lambda p, i: F.struct(key_of(p).alias("k"), i.alias("i"), p.alias("p")))
    ordered = F.transform(F.array_sort(keyed), lambda s: _safe_pair(s["p"]))
    return F.when(part(col, "host").isNotNull(), _rebuilt(col, ordered)).otherwise(redact(col, MAX_URL))


def run_url(col: Column) -> Column:
    """An https URL without query and fragment; null if it isn't one or has credentials."""
    fine = (part(col, "scheme") == "https") & part(col, "user").isNull() & part(col, "host").isNotNull()
    return F.when(fine, _rebuilt(col, F.array().cast("array<string>")))


def origin(col: Column) -> Column:
    """scheme://host[:port] of an absolute URL, usual ports left out; null for other text."""
    bare = F.concat(part(col, "scheme"), F.lit("://"), part(col, "host"))
    port = part(col, "port")
    usual = ((part(col, "scheme") == "https") & (port == "443")) | ((part(col, "scheme") == "http") & (port == "80"))
    return F.when(port.isNull() | usual, bare).otherwise(F.concat(bare, F.lit(":"), port))


def allowed_origins(col: Column, authorised: Column) -> Column:
    """Set of the origins that a monitored URL may lead to: its own, and those of an array of URLs."""
    more = F.transform(F.coalesce(authorised, F.array().cast("array<string>")), origin)
    return F.array_sort(F.array_compact(F.array_distinct(F.concat(F.array(origin(col)), more))))


def public_url_problem(col: Column) -> Column:
    """Why a URL may not be monitored, from its text alone; null if it may."""
    return (
        F.when(col.isNull() | (col == "") | (F.length(col) > MAX_URL), "length")
        .when(part(col, "host").isNull(), "unparseable")
        .when(part(col, "scheme") != "https", "scheme")
        .when(part(col, "user").isNotNull(), "credentials")
        .when(part(col, "fragment").isNotNull(), "fragment")
        .when(part(col, "port").isNotNull() & (part(col, "port") != "443"), "port")
        .when(F.exists(pairs(col), lambda p: key_of(p).rlike(CREDENTIAL_KEY)), "credential_key")
    )
