"""Reports, digests and review rows over classified changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators import facts

#: Severities from least to most.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
#: Bounds of a digest, a payload and a Markdown document.
DIGEST, PAYLOAD, SECTIONS = 100, 10, 50


def severity_rank(col: Column) -> Column:
    return F.coalesce(*[F.when(col == s, F.lit(k)) for k, s in enumerate(SEVERITIES)])


def material(changes: DataFrame, minimum: str) -> DataFrame:
    return changes.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(minimum))


def digest_order() -> list[Column]:
    """Most severe and most certain first, then target and field; the change's row ends all ties."""
    return [
        severity_rank(F.col("severity")).desc_nulls_last(),
        F.col("confidence_score").desc_nulls_last(),
        facts.in_order("target_name").asc_nulls_last(),
        facts.in_order("field_path").asc_nulls_last(),
        F.col("change_row"),
    ]


def unique_changes(changes: DataFrame) -> DataFrame:
    """First row of each change id; rows without an id are left out."""
    carry = [c for c in changes.columns if c != "change_id"]
    return facts.first_wins(changes.filter("change_id IS NOT NULL"), ["change_id"], [F.col("change_row")], carry)


def digest(changes: DataFrame, limit: int = DIGEST) -> DataFrame:
    """The first changes of all in digest order (a top-k report)."""
    return unique_changes(changes).orderBy(*digest_order()).limit(limit)


def unique_in(changes: DataFrame, key: str) -> DataFrame:
    """First row of each change id within a key; rows without an id are left out."""
    carry = [c for c in changes.columns if c not in ("change_id", key)]
    return facts.first_wins(changes.filter("change_id IS NOT NULL"), [key, "change_id"], [F.col("change_row")], carry)


def payloads(changes: DataFrame, key: str, limit: int = PAYLOAD) -> DataFrame:
    """The first changes of each payload in digest order, each change once, with their place."""
    return facts.top_per_group(unique_in(changes, key), [key], digest_order(), limit)


def rollup(changes: DataFrame, key: str) -> DataFrame:
    """Per key: changes, highest severity, and mean confidence rounded half up."""
    rank = severity_rank(F.col("severity"))
    return changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("change_count"),
        F.coalesce(F.max_by("severity", rank), F.lit("informational")).alias("highest_severity"),
        F.coalesce(F.floor(F.avg("confidence_score") + 0.5), F.lit(0)).alias("overall_confidence"),
    )


def zero_filled(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of the given values of a column, 0 for those that are absent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return known.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def review_rows(changes: DataFrame, columns: list[str]) -> DataFrame:
    """One CSV line per change, safe for spreadsheets."""
    line = F.concat_ws(",", *[text.csv_cell(F.col(c)) for c in columns])
    return changes.select("change_row", line.alias("line"))


#: Columns of a review file, of the report and of its change.
REVIEW_REPORT = ("target_name", "target_url", "status", "checked_at")
REVIEW_CHANGE = ("category", "field_path", "previous", "current", "delta_percent", "severity", "confidence_score")


def review_lines(reports: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Lines of a review file as (part, report, line_no, line): the header, then one line per change.

    ``reports`` has ``key`` and REVIEW_REPORT, ``changes`` has ``key``, ``change_row`` and
    REVIEW_CHANGE. A report without changes has one line with the change's cells empty. The file
    is the lines in the order of part, report and line_no.
    """
    held = changes.select(F.col(key).alias("key_"), F.col("change_row").alias("line_no"), *REVIEW_CHANGE)
    own = reports.select(F.col(key).alias("report"), *REVIEW_REPORT)
    rows = own.join(held, F.col("report") == F.col("key_"), "left").drop("key_")
    cells = [text.csv_cell(F.col(c)) for c in (*REVIEW_REPORT, *REVIEW_CHANGE)]
    lines = rows.select(F.lit(1).alias("part"), F.col("report"), "line_no", F.concat_ws(",", *cells).alias("line"))
    header = ",".join(f'"{c}"' for c in (*REVIEW_REPORT, *REVIEW_CHANGE))
    kinds = dict(lines.dtypes)
    top = reports.sparkSession.range(1).select(
        F.lit(0).alias("part"),
        F.lit(None).cast(kinds["report"]).alias("report"),
        F.lit(None).cast(kinds["line_no"]).alias("line_no"),
        F.lit(header).alias("line"),
    )
    return top.unionByName(lines)


def markdown_sections(changes: DataFrame, limit: int = SECTIONS) -> DataFrame:
    """One Markdown section per change of a digest with its place."""
    esc = text.escape_markdown
    placed = facts.top_per_group(
        digest(changes, limit).withColumn("all_", F.lit(0)), ["all_"], digest_order(), limit
    )
    body = F.concat(
        F.lit("## "),
        F.col("place"),
        F.lit(". "),
        esc(F.col("target_name")),
        F.lit(" - "),
        esc(F.col("severity")),
        F.lit("\n\n- Field: "),
        esc(F.col("field_path")),
        F.lit("\n- Confidence: "),
        F.col("confidence_score"),
        F.lit("/100\n- Source: "),
        F.col("target_url"),
        F.lit("\n"),
    )
    return placed.select("place", body.alias("section"))


def markdown_document(changes: DataFrame, title: str, generated_at: str, run: str | None = None) -> DataFrame:
    """The digest as one Markdown text: title, counts, sections, the run's link; redacted, 50,000 characters at most.

    The text is made of the first SECTIONS sections only, so it is bounded whatever the changes.
    """
    sections = markdown_sections(changes).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("place", "section"))).alias("s")
    )
    unique = unique_changes(changes).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_url").alias("t"))
    head = F.concat(
        F.lit(f"# {title}\n\nGenerated: {generated_at}\nChanged targets: "), F.col("t"), F.lit("\nMaterial changes: "), F.col("n"), F.lit("\n\n")
    )
    body = F.when(F.col("n") == 0, "No material changes met the selected threshold.\n").otherwise(
        F.array_join(F.transform("s", lambda x: x["section"]), "\n")
    )
    link = urls.run_url(F.lit(run))
    end = F.when(link.isNotNull(), F.concat(F.lit("\nRun: "), link, F.lit("\n"))).otherwise(F.lit(""))
    made = F.substring(F.concat(head, body, end), 1, text.MAX_TEXT)
    return unique.withColumn("one_", F.lit(0)).join(sections.withColumn("one_", F.lit(0)), "one_").select(text.redact(made, text.MAX_TEXT).alias("document"))


def write_outputs(changes: DataFrame, folder: str, columns: list[str]) -> None:
    """Digest as JSON, sections as text and review lines as text, below a folder."""
    digest(changes).coalesce(1).write.mode("overwrite").json(f"{folder}/digest")
    markdown_sections(changes).coalesce(1).orderBy("place").select("section").write.mode("overwrite").text(
        f"{folder}/digest_markdown"
    )
    review_rows(changes, columns).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(
        f"{folder}/review"
    )


def safe_urls(changes: DataFrame) -> DataFrame:
    return changes.withColumn("target_url", urls.redact_url(F.col("target_url")))


def payload_documents(changes: DataFrame, key: str, limit: int = PAYLOAD) -> DataFrame:
    """One JSON document per payload: its id, how many changes it could hold, and the first of them.

    The id is the hash of a JSON document of the payload's key and its change ids in order, so
    sending it again can be noticed. A change that a payload holds twice counts once.
    """
    fields = ["change_id", "target_name", "target_url", "category", "field_path", "severity", "confidence_score"]
    counts = unique_in(changes, key).groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    first = payloads(changes, key, limit).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", *fields))).alias("first_")
    )
    shown = F.transform("first_", lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    ids = F.to_json(F.transform("first_", lambda c: c["change_id"]))
    delivery = F.sha2(F.concat(F.lit('{"key":'), F.col(key).cast("string"), F.lit(',"changes":'), ids, F.lit("}")), 256)
    return counts.join(first, key).select(
        key,
        "total",
        delivery.alias("delivery_hash"),
        F.to_json(
            F.struct(delivery.alias("deliveryId"), F.col("total").alias("totalEligibleChanges"), shown.alias("changes")),
            {"ignoreNullFields": "false"},
        ).alias("payload"),
    )


#: Characters of the texts of a digest.
NAME, FIELD, SAID, SHOWN = 100, 256, 300, 240


def digest_rows(changes: DataFrame) -> DataFrame:
    """The changes of a digest with every text redacted and cut to the digest's bounds."""
    return changes.select(
        "change_row",
        "change_id",
        text.redact(F.col("target_name"), NAME).alias("target_name"),
        urls.redact_url(F.col("target_url")).alias("target_url"),
        "category",
        text.redact(F.col("field_path"), FIELD).alias("field_path"),
        "severity",
        "confidence_score",
        text.redact(F.col("explanation"), SAID).alias("explanation"),
        F.nullif(text.redact(F.col("previous_excerpt"), SHOWN), F.lit("")).alias("previous_excerpt"),
        F.nullif(text.redact(F.col("current_excerpt"), SHOWN), F.lit("")).alias("current_excerpt"),
    )
