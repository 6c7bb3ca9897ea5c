"""What changed between full snapshots of a table.

Every key is windowed by the index of its snapshot: the lag of the value's hash shows a
change, a gap in the indexes shows a removal and a later addition. Snapshots with the hash of
the one before them are left out first, since their facts are equal.

Positions of a target's snapshots are found in two levels (per month, then over months), so that
a target with a third of all snapshots is spread over its months instead of filling one task.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import hot_split
from tidemark.session import stored

#: Days of a bucket in which the snapshots of a target are ordered by one task.
BUCKET_DAYS = 32

_HEX = "^(?:[0-9a-f]{2})+$"


def packed_key(col: str) -> Column:
    """Text as binary; hex text in half the bytes. One to one, for keys in shuffles."""
    text = F.col(col)
    return F.when(text.rlike(_HEX), F.concat(F.lit(b"\x00"), F.unhex(text))).otherwise(
        F.concat(F.lit(b"\x01"), F.encode(text, "UTF-8"))
    )


def unpacked_key(col: str) -> Column:
    """Text of :func:`packed_key`."""
    body = F.expr(f"substring({col}, 2)")
    return F.when(
        F.expr(f"substring({col}, 1, 1) = X'00'"), F.lower(F.hex(body))
    ).otherwise(F.decode(body, "UTF-8"))


def positioned(df: DataFrame, keys: list[str], order: list[str], bucket: Column, carry: list[str]) -> DataFrame:
    """Add ``position`` (from 1), ``prev`` and ``next`` (structs of ``carry``) within ``keys`` by ``order``.

    The result is that of one window per key, but no task ever holds more than a bucket of a
    key; ``bucket`` must not decrease along ``order``.
    """
    df = df.withColumn("bucket_", bucket)
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in carry if c not in order]]])
    blocks = df.groupBy(*keys, "bucket_").agg(
        F.count(F.lit(1)).alias("n_"), F.min(item).alias("first_"), F.max(item).alias("last_")
    )
    over = Window.partitionBy(*keys).orderBy("bucket_")
    blocks = blocks.select(
        *keys,
        "bucket_",
        F.coalesce(F.sum("n_").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"),
        F.lag("last_").over(over).alias("before_"),
        F.lead("first_").over(over).alias("after_"),
    )
    within = Window.partitionBy(*keys, "bucket_").orderBy(*order)
    return (
        df.join(blocks, [*keys, "bucket_"])
        .withColumn("item_", item)
        .withColumn("position", F.col("base_") + F.row_number().over(within))
        .withColumn("prev", F.coalesce(F.lag("item_").over(within), F.col("before_")))
        .withColumn("next", F.coalesce(F.lead("item_").over(within), F.col("after_")))
        .drop("bucket_", "base_", "before_", "after_", "item_")
    )


def trusted_snapshots(manifests: DataFrame) -> DataFrame:
    """Snapshots as (t, g, idx, next_g) without those whose hash is that of the one before.

    Distinct generations of manifests of kind 'trusted', ordered by created_at, then generation.
    A manifest that was delivered again counts once. ``idx`` is dense from 1 per target. Snapshot
    hashes are carried as 64 bits, since only neighbours are compared; a null hash equals none.
    """
    once = (
        manifests.filter(
            (F.col("manifest_kind") == "trusted")
            & F.col("target_identity").isNotNull()
            & F.col("generation").isNotNull()
        )
        .select(
            packed_key("target_identity").alias("t"),
            F.col("generation").alias("g"),
            "created_at",
            F.when(F.col("snapshot_hash").isNotNull(), F.xxhash64("snapshot_hash")).alias("h"),
        )
        .groupBy("t", "g")
        .agg(F.min("created_at").alias("c"), F.min("h").alias("h"))
    )
    span = F.coalesce(F.floor(F.unix_date(F.to_date("c")) / BUCKET_DAYS), F.lit(-1_000_000))
    seen = positioned(once, ["t"], ["c", "g"], span, ["h"])
    starts = seen.filter(F.col("prev").isNull() | ~F.col("h").eqNullSafe(F.col("prev.h")) | F.col("h").isNull())
    placed = positioned(starts.select("t", "g", "c"), ["t"], ["c", "g"], span, ["g"])
    return placed.select("t", "g", F.col("position").cast("int").alias("idx"), F.col("next.g").alias("next_g"))


def _canonical(value):
    if isinstance(value, bool) or value is None:
        return "true" if value is True else "false" if value is False else "null"
    if isinstance(value, (int, float)):
        return "d" + repr(float(value) + 0.0)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value))
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    named = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
    return "{" + ",".join(f"{json.dumps(k)}:{_canonical(named[k])}" for k in sorted(named)) + "}"


def _refused(text):
    raise ValueError(text)


def canonical_json(text: str | None) -> str | None:
    """One spelling for each JSON value; text that is no JSON stands for itself."""
    if text is None:
        return None
    try:
        return _canonical(json.loads(text, parse_constant=_refused, parse_int=float))
    except (ValueError, RecursionError, OverflowError):
        return "raw:" + text


def _canonical_batch(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    made = [canonical_json(x) for x in distinct] + [None]
    return pd.Series([made[c] for c in codes], index=texts.index, dtype=object)


def value_hash(col: str) -> Column:
    """64-bit hash of a JSON value: equal for all spellings of it, null text is JSON null.

    Plain numbers, words and ASCII strings are read by built-in expressions; only arrays,
    objects, escapes and other scripts go through Python.
    Only consecutive values of one key are compared, so a collision needs 2^64 comparisons.
    """
    text = F.trim(F.regexp_replace(F.col(col), r"^[\t\r\n]+|[\t\r\n]+$", " "))
    number = F.when(
        text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double") + F.lit(0.0)
    )
    plain = F.when(text.rlike(r'^"[ !#-\[\]-~]*"$'), text)
    word = F.when(text.isin("true", "false", "null"), text)
    slow = F.pandas_udf(_canonical_batch, T.StringType())(F.when(number.isNull() & plain.isNull() & word.isNull(), F.col(col)))
    return (
        F.when(F.col(col).isNull(), F.xxhash64(F.lit("null")))
        .when(number.isNotNull(), F.xxhash64(F.lit("d"), number))
        .when(plain.isNotNull(), F.xxhash64(plain))
        .when(word.isNotNull(), F.xxhash64(word))
        .otherwise(F.xxhash64(slow))
    )


def snapshot_facts(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row (t, fact_id, idx, h, last) per fact of a snapshot; the lowest ord counts.

    Two shuffles: by snapshot for the join, where copies of a fact meet and are aggregated in
    place, and by (t, fact_id) for what is left, whose partitioning the window over snapshots
    shares. Snapshots that hold a share of all facts are split by a hash of the row, so copies
    of their facts meet after the second shuffle only, aggregated in parts before it.
    """
    raw = facts.filter(
        F.col("target_identity").isNotNull() & F.col("generation").isNotNull() & F.col("fact_id").isNotNull()
    ).select(
        packed_key("target_identity").alias("t"),
        F.col("generation").alias("g"),
        "fact_id",
        (
            F.coalesce(F.col("ord").cast("decimal(38,0)"), F.lit("3000000000000000000").cast("decimal(38,0)"))
            * F.lit("10000000000000000000").cast("decimal(20,0)")
            + F.coalesce(F.col("fact_row"), F.lit(0))
        ).cast("decimal(38,0)").alias("rank"),
        value_hash("fact_value").alias("h"),
    )
    known = snapshots.select("t", "g", "idx", F.col("next_g").isNull().alias("last"))
    parts = (
        hot_split(raw, known, ["t", "g"], "rank")
        .groupBy("t", "g", "part_", "fact_id", "idx", "last")
        .agg(F.min_by("h", "rank").alias("h"), F.min("rank").alias("rank"))
    )
    return (
        parts.select("t", "fact_id", "idx", "last", "h", "rank")
        .repartition("t", "fact_id")
        .groupBy("t", "fact_id", "idx", "last")
        .agg(F.min_by("h", "rank").alias("h"))
    )


def snapshot_changes(manifests: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts added, removed or changed as (target_identity, generation, fact_id, change_kind).

    The first snapshot of a target yields nothing; a snapshot without facts is empty, so all
    facts before it are removed. Null keys name no fact and are left out; a null value is JSON
    null. Empty tables give no rows.

    The snapshots are indexed once and written to the checkpoint folder: facts and events are
    joined with a table of known size, by broadcast while it is small, by a shuffle beyond.
    The names of generations are fetched for the events only, since to carry two of them with
    every fact through both shuffles costs more than to join the few facts that changed.
    """
    snapshots = stored(trusted_snapshots(manifests))
    over = Window.partitionBy("t", "fact_id").orderBy("idx")
    seen = snapshot_facts(facts, snapshots).select(
        "t",
        "fact_id",
        "idx",
        "last",
        "h",
        F.lag("idx").over(over).alias("prev_idx"),
        F.lag("h").over(over).alias("prev_h"),
        F.lead("idx").over(over).alias("next_idx"),
    )
    here = (
        F.when((F.col("idx") > 1) & (F.col("prev_idx").isNull() | (F.col("prev_idx") < F.col("idx") - 1)), F.lit("added"))
        .when((F.col("prev_idx") == F.col("idx") - 1) & (F.col("h") != F.col("prev_h")), F.lit("changed"))
    )
    gone = F.when(
        ~F.col("last") & (F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1)), F.lit("removed")
    )
    events = seen.select(
        "t",
        "fact_id",
        F.explode(
            F.array(
                F.struct(F.col("idx").alias("idx"), here.alias("change_kind")),
                F.struct((F.col("idx") + 1).alias("idx"), gone.alias("change_kind")),
            )
        ).alias("e"),
    ).filter(F.col("e.change_kind").isNotNull())
    return (
        events.select("t", "fact_id", "e.idx", "e.change_kind")
        .join(snapshots.select("t", "idx", "g"), ["t", "idx"])
        .select(unpacked_key("t").alias("target_identity"), F.col("g").alias("generation"), "fact_id", "change_kind")
    )
