"""Versions over time: latest, last n, carried dates, lineage, spacing, and stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.operators import facts, snapshots

#: Entries of a history that stay, bytes of a chunk, fewest bytes of one, and most chunks of a text.
HISTORY, CHUNK, LEAST_CHUNK, CHUNKS = 30, 512 * 1024, 64 * 1024, 32


def chunk_size(wanted: int | None = None) -> int:
    """Bytes of a stored chunk: what is wanted within its bounds."""
    return min(max(CHUNK if wanted is None else wanted, LEAST_CHUNK), CHUNK)


#: Forms of a generation and of a candidate's id.
GENERATION, CANDIDATE = "^[A-Za-z0-9_-]{1,64}$", "^[A-Za-z0-9_-]{1,128}$"


def manifest_problem(df: DataFrame) -> Column:
    """Why a manifest can't be used, the first reason found; null for a fine one.

    ``df`` only tells which columns there are: chunk counts and histories are checked if it has
    them (chunk_count, history_length).
    """
    is_hash = lambda c: F.coalesce(canon.is_hash(F.col(c)), F.lit(False))
    has = lambda c, test: test if c in df.columns else F.lit(False)
    candidate = F.col("manifest_kind") == "candidate"
    parent = F.col("trusted_parent_snapshot_hash")
    return (
        F.when(F.col("manifest_kind").isNull() | ~F.col("manifest_kind").isin("trusted", "candidate"), "kind")
        .when(~is_hash("target_identity"), "identity")
        .when(~is_hash("snapshot_hash") | ~F.coalesce(F.col("generation").rlike(GENERATION), F.lit(False)), "hash_or_generation")
        .when(F.col("created_at").isNull() | F.col("updated_at").isNull(), "timestamps")
        .when(F.col("byte_length").isNull() | (F.col("byte_length") < 2), "byte_length")
        .when(has("chunk_count", ~F.coalesce(F.col("chunk_count").between(1, 32), F.lit(False)) if "chunk_count" in df.columns else None), "chunks")
        .when(has("history_length", F.col("history_length") > HISTORY if "history_length" in df.columns else None), "history")
        .when(
            candidate
            & (~F.coalesce(F.col("candidate_id").rlike(CANDIDATE), F.lit(False)) | (parent.isNotNull() & ~canon.is_hash(parent))),
            "lineage",
        )
    )


def promotable(manifests: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (target_identity, candidate_id, expected_hash, expected_parent) with ``promotion``.

    'match' where three hashes agree: the candidate's own with the expected one, its parent and
    the target's latest trusted snapshot with the expected parent ('NO_PARENT' for none).
    Otherwise 'no_candidate', 'hash', 'parent' or 'trusted', the first that fails. Manifests with
    a problem don't count; of a candidate that was delivered again the latest row does.
    """
    fine = manifests.filter(manifest_problem(manifests).isNull())
    candidates = (
        fine.filter("manifest_kind = 'candidate'")
        .groupBy("target_identity", "candidate_id")
        .agg(F.max(F.struct("created_at", "snapshot_hash", "trusted_parent_snapshot_hash")).alias("c"))
    )
    trusted = latest_trusted(fine).select("target_identity", F.col("snapshot_hash").alias("trusted_hash"))
    parent = F.nullif(F.col("expected_parent"), F.lit("NO_PARENT"))
    verdict = (
        F.when(F.col("c").isNull(), "no_candidate")
        .when(~F.col("c.snapshot_hash").eqNullSafe(F.col("expected_hash")), "hash")
        .when(~F.col("c.trusted_parent_snapshot_hash").eqNullSafe(parent), "parent")
        .when(~F.col("trusted_hash").eqNullSafe(parent), "trusted")
        .otherwise("match")
    )
    return (
        requests.join(candidates, ["target_identity", "candidate_id"], "left")
        .join(trusted, "target_identity", "left")
        .withColumn("promotion", verdict)
        .drop("c", "trusted_hash")
    )


def latest_trusted(manifests: DataFrame) -> DataFrame:
    """Latest trusted manifest per target; redelivered rows of a generation count once."""
    rows = manifests.filter("manifest_kind = 'trusted'")
    item = F.struct("created_at", "generation", "snapshot_hash")
    return (
        rows.groupBy("target_identity")
        .agg(F.max(item).alias("m"), F.min("created_at").alias("first_created_at"))
        .select("target_identity", "m.generation", "m.snapshot_hash", "m.created_at", "first_created_at")
    )


def last_entries(history: DataFrame, limit: int = HISTORY, at: str | None = None) -> DataFrame:
    """Last entries per target, repeated rows once: by the instant ``at`` if it is given, then by entry id.

    Entries without an instant are the oldest.
    """
    times = [] if at is None else [F.max(at).alias("at_")]
    once = history.groupBy("target_identity", "entry_id").agg(
        F.min("snapshot_hash").alias("snapshot_hash"), F.min("check_status").alias("check_status"), *times
    )
    order = [*([] if at is None else [F.col("at_").desc_nulls_last()]), F.col("entry_id").desc()]
    return facts.top_per_group(once, ["target_identity"], order, limit)


def lineage(manifests: DataFrame) -> DataFrame:
    """Candidates with whether their parent is the target's latest trusted snapshot."""
    trusted = latest_trusted(manifests).select("target_identity", F.col("snapshot_hash").alias("trusted_hash"))
    return (
        manifests.filter("manifest_kind = 'candidate'")
        .select("target_identity", "candidate_id", "snapshot_hash", "trusted_parent_snapshot_hash")
        .distinct()
        .join(trusted, "target_identity", "left")
        .withColumn(
            "lineage",
            F.when(F.col("trusted_hash").isNull(), "no_trusted")
            .when(F.col("trusted_parent_snapshot_hash").isNull(), "no_parent")
            .when(F.col("trusted_parent_snapshot_hash") == F.col("trusted_hash"), "match")
            .otherwise("mismatch"),
        )
    )


def spacing(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Microseconds since the key's event before.

    Events are ordered by a key's days first, so a hot key is spread over its days. An event without
    a time comes before all others and has no gap, nor has the one after it.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    # The key as text has no null, which would match nothing in a join.
    rows = events.select(
        F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), F.col(key).alias("name"), F.col(tie).alias("tie"), micros.alias("us")
    )
    day = F.coalesce(F.floor(F.col("us") / 86_400_000_000), F.lit(-(10**9)))
    placed = snapshots.positioned(rows, ["k"], ["us", "tie"], day, [])
    return placed.select(F.col("name").alias(key), F.col("tie").alias(tie), (F.col("us") - F.col("prev.us")).alias("gap_us"))


def chunks(df: DataFrame, key: str, payload: str, size: int = CHUNK) -> DataFrame:
    """UTF-8 bytes of a text in chunks: (key, idx, byte_length, sha256, chunk).

    For a store, ``size`` is that of :func:`chunk_size`; :func:`too_many_chunks` tells which texts
    it refuses.
    """
    data = F.encode(F.col(payload), "UTF-8")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int"))
    parts = F.transform(starts, lambda i: F.substring(data, i * size + 1, F.lit(size)))
    return (
        df.filter(F.col(payload).isNotNull())
        .select(key, F.posexplode(parts).alias("idx", "chunk"))
        .select(key, "idx", F.octet_length("chunk").alias("byte_length"), F.sha2("chunk", 256).alias("sha256"), "chunk")
    )


def too_many_chunks(payload: Column, size: int = CHUNK) -> Column:
    """Whether a text needs more chunks than a store takes; null of null."""
    return F.ceil(F.octet_length(F.encode(payload, "UTF-8")) / size) > CHUNKS


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """Texts of :func:`chunks` in order, with whether every chunk has its hash and none is missing.

    A text that isn't intact is null.
    """
    ok = F.sha2("chunk", 256) == F.col("sha256")
    piece = F.struct("idx", F.hex("chunk").alias("hex"))
    joined = F.decode(F.unhex(F.array_join(F.transform("pieces", lambda p: p["hex"]), "")), "UTF-8")
    return (
        parts.groupBy(key)
        .agg(
            F.array_sort(F.collect_list(piece)).alias("pieces"),
            F.bool_and(ok).alias("intact"),
            F.sum("byte_length").alias("byte_length"),
            (F.max("idx") + 1 == F.count(F.lit(1))).alias("complete"),
        )
        .select(
            key,
            (F.col("intact") & F.col("complete")).alias("intact"),
            "byte_length",
            F.when(F.col("intact") & F.col("complete"), joined).alias("text"),
        )
    )


def obsolete(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored keys that the current version no longer has."""
    return previous.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")
