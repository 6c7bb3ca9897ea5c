"""Joins and groups whose keys may be hot.

A key is hot if it holds more rows than a task should, and more than a small share of all. By the
latter there are at most ``MOST`` hot keys, whatever the data, so they fit on the driver and into
a broadcast; by the former the number of parts of a key grows with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is split, and of a part; most hot keys.
ROWS, MOST = 100_000, 5_000


def hot_parts(df: DataFrame, key: str, rows: int | None = None, most: int | None = None) -> dict:
    """Hot keys with the number of parts to split them into: counts with map-side aggregation.

    A key is hot from ``rows`` rows and a share of 1 / ``most`` of all, so there are at most
    ``most`` of them, and all other keys have fewer rows than that. Null is no key.
    """
    rows, most = rows or ROWS, most or MOST
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    least = max(rows, -(-total // most))
    found = counts.filter(F.col("n") >= least).collect() if total >= least else []
    return {r[key]: -(-r["n"] // least) for r in found}


def with_parts(df: DataFrame, key: Column, parts: dict) -> DataFrame:
    """Adds ``parts_``, the number of parts of ``key``: 1 unless it is hot.

    The join is with at most MOST rows, so it is broadcast.
    """
    if not parts:
        return df.withColumn("parts_", F.lit(1))
    known = df.sparkSession.createDataFrame(list(parts.items()), ["hot_", "parts_"])
    kept = df.withColumn("at_", key).join(F.broadcast(known), F.col("at_") == F.col("hot_"), "left").drop("at_", "hot_")
    return kept.withColumn("parts_", F.coalesce(F.col("parts_").cast("int"), F.lit(1)))


def part_of(by: Column | str) -> Column:
    """The part, of the ``parts_`` of its key, that a row goes to by a hash of ``by``."""
    return F.pmod(F.xxhash64(by), F.col("parts_")).cast("int")


def each_part() -> Column:
    """All parts of a key, to repeat a row of the other side for each."""
    return F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))


def left_join_spread(big: DataFrame, small: DataFrame, key: str, by: str, rows: int | None = None) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique per key) that splits hot keys by a hash of ``by``.

    Rows of a hot key go to as many parts as they need, the row of ``small`` that they match is
    repeated for each. Null keys match nothing; they are spread by ``by`` over 32 parts.
    """
    parts = hot_parts(big, key, rows)
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(32)).cast("int")).otherwise(part_of(by))
    left = with_parts(big, F.col(key), parts).withColumn("part_", spread).drop("parts_").withColumn("key_", F.col(key))
    right = repeated(small.filter(F.col(key).isNotNull()), F.col(key), parts).withColumnRenamed(key, "key_")
    return left.join(right, ["key_", "part_"], "left").drop("key_", "part_")


def placed(df: DataFrame, key: Column, parts: dict, by: str) -> DataFrame:
    """Adds ``part_``, the part of its key that a row goes to; a constant if no key is hot."""
    if not parts:
        return df.withColumn("part_", F.lit(0))
    return with_parts(df, key, parts).withColumn("part_", part_of(by)).drop("parts_")


def repeated(df: DataFrame, key: Column, parts: dict) -> DataFrame:
    """Repeats rows for each part of their key, named ``part_``."""
    if not parts:
        return df.withColumn("part_", F.lit(0))
    return with_parts(df, key, parts).withColumn("part_", each_part()).drop("parts_")


def hot_split(big: DataFrame, small: DataFrame, keys: list[str], by: str, rows: int | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small`` (unique per ``keys``) with hot keys split by a hash of ``by``.

    Returns the join with its column ``part_``; it is partitioned by ``keys`` and ``part_``, so an
    aggregation by these and more columns needs no further shuffle.
    """
    key = F.xxhash64(*keys)
    parts = hot_parts(big.select(key.alias("key_")), "key_", rows)
    return placed(big, key, parts, by).join(repeated(small, key, parts), [*keys, "part_"])
