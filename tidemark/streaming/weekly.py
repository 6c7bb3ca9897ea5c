"""Pending changes per destination: weekly, as a stream with keyed state and as a batch, and at once.

The window is a calendar week in a named zone, so its start comes from local dates. What is not
delivered stays pending, the most severe first: pending changes leave the state only when a
delivery of theirs is acknowledged, and a failed or forgotten one is sent again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import dates
from tidemark.operators.facts import first_wins, top_per_group

#: Changes that stay pending per destination; a bound of the feature, as of its store.
PENDING = 100
#: Milliseconds after which an unanswered delivery is sent again, and between two looks at the clock.
LEASE, LOOK = 15 * 60_000, 60_000
OUTPUT = "destination string, window_start string, status string, delivery_id string, pending int, change_ids array<string>"
STATE = (
    "ids array<string>, ranks array<int>, confidences array<int>, delivered_window string, sending_id string, "
    "sending_window string, sent array<string>, expires long, clock long"
)


class Pending(NamedTuple):
    """State of a destination; times are milliseconds since 1970, -1 for none."""

    ids: list[str]
    ranks: list[int]
    confidences: list[int]
    delivered_window: str
    sending_id: str
    sending_window: str
    sent: list[str]
    expires: int
    clock: int


EMPTY = Pending([], [], [], "", "", "", [], -1, -1)


def windows(df: DataFrame, at: str, zone: str) -> DataFrame:
    """Adds the local week's Monday and the local weekday."""
    return df.withColumn("window_start", dates.week_start(F.col(at), zone).cast("string")).withColumn(
        "week_day", dates.week_day(F.col(at), zone)
    )


def local_week(millis: int, zone: str) -> tuple[str, int]:
    """The week's Monday and the weekday (1 is Monday) of an instant in a zone."""
    day = dt.datetime.fromtimestamp(millis / 1000, ZoneInfo(zone)).date()
    return str(day - dt.timedelta(days=day.weekday())), day.isoweekday()


def merge_pending(old: list[tuple], new: list[tuple], limit: int = PENDING) -> list[tuple]:
    """Old before new, first of an id wins; by rank and confidence, nulls last, then id, the first ``limit``."""
    seen: dict[str, tuple] = {}
    for item in [*old, *new]:
        seen.setdefault(item[0], item)
    least = lambda v: -1 if v is None else v
    return sorted(seen.values(), key=lambda c: (-least(c[1]), -least(c[2]), c[0]))[:limit]


def delivery_id(destination: str, window: str, ids: list[str]) -> str:
    """Hash of the JSON of what a delivery holds, so that sending it again can be noticed."""
    return hashlib.sha256(json.dumps({"destination": destination, "window": window, "changes": ids}).encode()).hexdigest()


def advance(state: Pending, destination: str, rows: list[tuple], now: int, zone: str, day: int) -> tuple[Pending, list[tuple]]:
    """One step of a destination: its new state, and what there is to tell, as rows of OUTPUT.

    ``rows`` are (kind, change_id, rank, confidence, millis): 'change', or 'sent' or 'failed' with
    a delivery's id, in any order. Time never runs back: ``now`` counts if it is later than all
    that was seen. A delivery starts on the weekday ``day`` once a week, and again after its lease.
    """
    told: list[tuple] = []

    def tell(window: str, status: str, ident: str | None, ids: list[str]) -> None:
        told.append((destination, window, status, ident, len(state.ids), ids))

    items = list(zip(state.ids, state.ranks, state.confidences, strict=True))
    new = [(i, r, c) for kind, i, r, c, _ in rows if kind == "change" and i is not None]
    items = merge_pending(items, sorted(new, key=lambda x: x[0]))
    clock = max([state.clock, now, *[at for *_, at in rows if at is not None]])
    state = state._replace(clock=clock)
    answers = {i: kind for kind, i, *_ in rows if kind in ("sent", "failed")}
    if state.sending_id and (answer := answers.get(state.sending_id)):
        if answer == "sent":
            items = [x for x in items if x[0] not in set(state.sent)]
            state = state._replace(delivered_window=state.sending_window)
        ident, window, ids = state.sending_id, state.sending_window, state.sent
        state = state._replace(sending_id="", sending_window="", sent=[], expires=-1)
        state = state._replace(ids=[x[0] for x in items])
        tell(window, "delivered" if answer == "sent" else "failed", ident, ids)
    state = state._replace(
        ids=[x[0] for x in items], ranks=[-1 if x[1] is None else int(x[1]) for x in items],
        confidences=[-1 if x[2] is None else int(x[2]) for x in items],
    )
    window, weekday = local_week(clock, zone) if clock >= 0 else ("", 0)
    if weekday == day and state.ids and state.delivered_window != window and not (state.sending_id and clock < state.expires):
        ident = delivery_id(destination, window, state.ids)
        state = state._replace(sending_id=ident, sending_window=window, sent=list(state.ids), expires=clock + LEASE)
        tell(window, "sending", ident, list(state.ids))
    elif new:
        tell(window, "queued", None, [])
    return state, told


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["destination", "window_start", "status", "delivery_id", "pending", "change_ids"])


def weekly_stream(
    changes: DataFrame, zone: str = "UTC", delivery_day: int = 1, answers: DataFrame | None = None, look: int = LOOK
) -> DataFrame:
    """Streaming rows (destination, change_id, rank, confidence, at) to deliveries and their states.

    ``answers`` are streaming rows (destination, delivery_id, succeeded, at) of the sink. Every
    destination looks at the clock after ``look`` milliseconds without rows, so that a delivery
    starts on its day though nothing comes in. Rows without a destination are left out.
    """
    named = changes.select(
        "destination", F.lit("change").alias("kind"), "change_id", "rank", "confidence", F.unix_millis("at").alias("millis")
    )
    if answers is not None:
        told = F.when(F.col("succeeded"), "sent").otherwise("failed")
        none = F.lit(None).cast("int")
        named = named.unionByName(
            answers.select(
                "destination", told.alias("kind"), F.col("delivery_id").alias("change_id"), none.alias("rank"),
                none.alias("confidence"), F.unix_millis("at").alias("millis"),
            )
        )

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = Pending(*group.get) if group.exists else EMPTY
        held = held._replace(**{f: list(getattr(held, f)) for f in ("ids", "ranks", "confidences", "sent")})
        columns = ["kind", "change_id", "rank", "confidence", "millis"]
        rows = [
            tuple(None if pd.isna(v) else int(v) if k > 1 else v for k, v in enumerate(row))
            for frame in frames
            for row in frame[columns].itertuples(index=False)
        ]
        # Rows carry their own time; without them it is the clock's turn.
        now = group.getCurrentProcessingTimeMs() if group.hasTimedOut else -1
        held, out = advance(held, key[0], rows, now, zone, delivery_day)
        group.update(tuple(held))
        group.setTimeoutDuration(look)
        yield _frame(out)

    return (
        named.filter(F.col("destination").isNotNull())
        .groupBy("destination")
        .applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    )


def pending_order() -> list[Column]:
    return [F.col("rank").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("change_id")]


def merged_pending(old: DataFrame, new: DataFrame, limit: int = PENDING) -> DataFrame:
    """Rows (destination, change_id, rank, confidence, row_no) of both, each change once, old before new.

    The first ``limit`` of a destination, with their places.
    """
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    rows = both.filter(F.col("change_id").isNotNull())
    once = first_wins(rows, ["destination", "change_id"], [F.col("side"), F.col("row_no")], ["side", "rank", "confidence"])
    return top_per_group(once, ["destination"], pending_order(), limit)


def weekly_batch(changes: DataFrame, zone: str = "UTC", limit: int = PENDING) -> DataFrame:
    """Per destination and week the changes that would be pending, each with its place."""
    rows = windows(changes, "at", zone)
    once = first_wins(
        rows, ["destination", "window_start", "change_id"], [F.col("row_no")], ["rank", "confidence"]
    )
    return top_per_group(once, ["destination", "window_start"], pending_order(), limit)


def immediate(changes: DataFrame, limit: int = 10) -> DataFrame:
    """The mode without state: per destination one delivery of the changes at hand, the first ``limit``.

    Rows (destination, total, delivery_id, change_ids). For a stream it is the function of
    ``foreachBatch``: what a batch holds is sent with it and nothing is kept.
    """
    rows = changes.filter(F.col("destination").isNotNull() & F.col("change_id").isNotNull())
    once = first_wins(rows, ["destination", "change_id"], [F.col("row_no")], ["rank", "confidence"])
    totals = once.groupBy("destination").agg(F.count(F.lit(1)).alias("total"))
    first = (
        top_per_group(once, ["destination"], pending_order(), limit)
        .groupBy("destination")
        .agg(F.array_sort(F.collect_list(F.struct("place", "change_id"))).alias("made"))
    )
    ids = F.transform("made", lambda m: m["change_id"])
    ident = F.sha2(F.concat(F.lit('{"destination":"'), "destination", F.lit('","changes":'), F.to_json(ids), F.lit("}")), 256)
    return totals.join(first, "destination").select("destination", "total", ident.alias("delivery_id"), ids.alias("change_ids"))
