"""Rules for crawlers: parsing of robots files and longest-match decisions as columns."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a robots file that is read; a longer one can't be judged, so nothing is allowed.
MAX_BYTES = 262_144
#: Statuses of a host without rules, and of one that refuses to show them.
NO_RULES, REFUSED = (204, 404, 410), (401, 403)


@lru_cache(maxsize=10_000)
def parse(body: str) -> tuple[tuple[frozenset[str], tuple[tuple[bool, str], ...]], ...]:
    """Groups of agents with their rules (allowed, path pattern) in order."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    open_ = False
    for line in body.splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not open_:
                groups.append((set(), []))
                open_ = True
            groups[-1][0].add(value.lower())
        elif field in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((field == "allow", value))
    return tuple((frozenset(a), tuple(r)) for a, r in groups)


@lru_cache(maxsize=100_000)
def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    parts = [re.escape(unquote(p)) for p in rule.rstrip("$").split("*")]
    return re.compile(".*".join(parts) + ("$" if end else ""), re.S)


def allowed(body: str | None, agent: str, path: str | None) -> bool:
    """Whether an agent may read a path: the longest rule decides, an allowing one on ties.

    Without a file, a group or a rule everything is allowed; with too long a file nothing is.
    """
    if not body:
        return True
    if len(body.encode()) > MAX_BYTES:
        return False
    groups = parse(body)
    mine = [r for a, rules in groups if agent.lower() in a for r in rules]
    if not any(agent.lower() in a for a, _ in groups):
        mine = [r for a, rules in groups if "*" in a for r in rules]
    hits = [(len(rule), allow) for allow, rule in mine if _pattern(rule).match(unquote(path or "/"))]
    return max(hits)[1] if hits else True


def may_read(body: Column, agent: str, path: Column) -> Column:
    """:func:`allowed` for its own agent and for all agents."""

    def batch(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([allowed(b, agent, p) and allowed(b, "*", p) for b, p in zip(bodies, paths, strict=True)], dtype=bool)

    return F.pandas_udf(batch, T.BooleanType())(body, path)


def by_status(status: Column) -> Column:
    """Whether a robots file's status alone decides: true or false; null if the file has to be read.

    Only a missing or empty file allows everything. A refusal, an error or an unknown status doesn't.
    """
    return (
        F.when(status.isin(*NO_RULES), True)
        .when(status.isNull() | ~status.between(200, 299), False)
    )


def readable(pages: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """Pages (host, path, …) that their host's file (host, robots) lets the agent read.

    If ``files`` has a column ``status``, it decides first, and hosts without a row can't be read.
    Without it a host that has no row has no rules.
    """
    has_status = "status" in files.columns
    status = F.col("status") if has_status else F.lit(200)
    known = files.select("host", F.col("robots").alias("robots_"), status.alias("robots_status_"))
    joined = pages.join(known, "host", "left")
    rules = may_read(F.col("robots_"), agent, F.col("path"))
    fine = F.coalesce(by_status(F.col("robots_status_")), rules) if has_status else rules
    return joined.filter(fine).drop("robots_", "robots_status_")
