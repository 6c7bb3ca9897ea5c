"""Target lists as closed JSON: unknown fields and bad values become problems of a row."""

from __future__ import annotations

from typing import NamedTuple
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canon, text, urls

_TEXTS = T.ArrayType(T.StringType())
TARGET = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("changeTypes", _TEXTS),
        T.StructField("includeSelectors", _TEXTS),
        T.StructField("excludeSelectors", _TEXTS),
        T.StructField("ignoreTextPatterns", _TEXTS),
        T.StructField("currency", T.StringType()),
        T.StructField("productIdentifiers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("authorizedRedirectOrigins", _TEXTS),
    ]
)
#: Fact categories; most items of the lists and most characters of an item; identifiers
#: of a product with their fewest and most characters.
CATEGORIES = ("price", "availability", "product_feature", "pricing_plan", "terms_policy", "launch_changelog", "general_content")
BOUNDS = {
    "includeSelectors": (10, 256),
    "excludeSelectors": (20, 256),
    "ignoreTextPatterns": (10, 128),
    "authorizedRedirectOrigins": (3, 512),
}
IDENTIFIERS = {"sku": (1, 128), "gtin": (8, 14), "mpn": (1, 128), "brand": (1, 128), "model": (1, 128), "variant": (1, 128), "packQuantity": (1, 64)}


class Setting(NamedTuple):
    """A field of a run: its kind, its default, and its choices or least and greatest value."""

    kind: str
    default: object
    bounds: tuple = ()


#: The settings of a run beside its targets. Kind 'given' has no default.
SETTINGS = {
    "confirmAuthorizedUse": Setting("boolean", False),
    "baselineAction": Setting("choice", "compare_only", ("compare_only", "initialize_trusted", "store_candidate", "promote_candidate")),
    "candidateId": Setting("given", None, (1, 128)),
    "expectedCandidateHash": Setting("given", None, (64, 64)),
    "expectedTrustedParentHash": Setting("given", None, (9, 64)),
    "includeUnchanged": Setting("boolean", False),
    "minimumMateriality": Setting("choice", "low", ("informational", "low", "medium", "high", "critical")),
    "notificationMode": Setting("choice", "none", ("none", "immediate", "weekly_digest")),
    "minimumAlertSeverity": Setting("choice", "medium", ("low", "medium", "high", "critical")),
    "alertWebhookUrl": Setting("url", None),
    "weeklyDigestDay": Setting("integer", 1, (1, 7)),
    "timezone": Setting("zone", "UTC"),
    "requestTimeoutSeconds": Setting("integer", 15, (3, 30)),
    "maxResponseBytes": Setting("integer", 2_097_152, (65_536, 5_242_880)),
    "maxRetries": Setting("integer", 1, (0, 2)),
    "dryRun": Setting("boolean", False),
}
#: Most targets of a run.
TARGETS = 25


def check_runs(rows: DataFrame) -> DataFrame:
    """Rows (json) as (json, run, problems): the settings with defaults for absent ones, and what is wrong.

    A setting of the wrong type, out of its bounds or unknown is a problem and null in ``run``. A
    null is of no type, except that a null zone is the default. Targets are only counted here; they
    are checked by :func:`check_targets`.
    """
    whole, keys = F.try_parse_json("json"), F.json_object_keys("json")
    fields, checks = [], [F.when(keys.isNull(), "no object")]
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in (*SETTINGS, "targets")]))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(unknown), ", "))))
    held = F.try_variant_get(whole, "$.targets", "array<variant>")
    checks.append(F.when(~F.coalesce(F.size(held), F.lit(0)).between(1, TARGETS), "targets"))
    for name, (kind, default, bounds) in SETTINGS.items():
        value = F.try_variant_get(whole, f"$.{name}", "variant")
        shape = F.schema_of_variant(value)
        said = F.trim(F.try_variant_get(whole, f"$.{name}", "string"))
        is_text = shape == "STRING"
        present = F.coalesce(F.array_contains(keys, name), F.lit(False))
        if kind == "zone":
            present = present & F.coalesce(shape != "VOID", F.lit(False))
        if kind == "boolean":
            typed, fine = F.try_variant_get(whole, f"$.{name}", "boolean"), shape == "BOOLEAN"
        elif kind == "integer":
            number = F.try_variant_get(whole, f"$.{name}", "double")
            typed = number.cast("bigint")
            fine = shape.rlike("^(?:BIGINT|DOUBLE|DECIMAL)") & (number == F.floor(number)) & number.between(*bounds)
        elif kind == "choice":
            typed, fine = said, is_text & said.isin(*bounds)
        elif kind == "zone":
            typed, fine = said, is_text & said.isin(*sorted(available_timezones()))
        elif kind == "url":
            typed, fine = said, is_text & urls.public_url_problem(said).isNull()
        else:
            typed, fine = said, is_text & F.length(said).between(*bounds)
        fine = F.coalesce(fine, F.lit(False))
        empty = F.lit(default) if default is not None else F.lit(None).cast("string")
        fields.append(F.when(~present, empty).when(fine, typed).alias(name))
        checks.append(F.when(present & ~fine, name))
    return rows.select("json", F.struct(*fields).alias("run"), F.array_compact(F.array(*checks)).alias("problems"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of JSON lines with ``problems``, an array that is empty for a fine row."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    return check_targets(raw.select(F.col("value").alias("json")))


def _longer_than(longest: int):
    return lambda x: x.isNull() | ~F.length(F.trim(x)).between(1, longest)


def _wrong_identifier(entry: Column) -> Column:
    """Whether an identifier of a product is unknown, of the wrong length, or a GTIN with other than digits."""
    length = F.length(F.trim(entry["value"]))
    fine = F.lit(False)
    for name, (least, most) in IDENTIFIERS.items():
        fine = fine | ((entry["key"] == name) & length.between(least, most))
    return ~F.coalesce(fine, F.lit(False)) | ((entry["key"] == "gtin") & ~entry["value"].rlike(r"^\s*[0-9]*\s*$"))


def check_targets(rows: DataFrame) -> DataFrame:
    """Rows (json) as (json, target, problems)."""
    t = F.col("target")
    known = F.array(*[F.lit(n) for n in TARGET.fieldNames()])
    unknown = F.array_except(F.json_object_keys("json"), known)
    types = F.coalesce(t["changeTypes"], F.array().cast("array<string>"))
    checks = [
        F.when(F.json_object_keys("json").isNull(), "no object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(unknown), ", "))),
        F.when(F.coalesce(F.length(F.trim(t["name"])), F.lit(0)).between(1, 100), None).otherwise("name"),
        F.concat(F.lit("url: "), urls.public_url_problem(t["url"])),
        F.when((F.size(types) == 0) | (F.size(F.array_except(types, F.array(*map(F.lit, CATEGORIES)))) > 0), "changeTypes"),
        F.when(F.size(types) != F.size(F.array_distinct(types)), "changeTypes repeat"),
        F.when(t["currency"].isNotNull() & ~t["currency"].rlike("^[A-Z]{3}$"), "currency"),
        *[
            F.when(
                (F.size(t[n]) > most)
                | F.exists(t[n], _longer_than(longest))
                | (F.size(F.array_distinct(t[n])) < F.size(t[n])),
                F.lit(n),
            )
            for n, (most, longest) in BOUNDS.items()
        ],
        F.when(F.exists(t["ignoreTextPatterns"], lambda p: p.rlike(r"[\\^$+|(){}\[\]]")), "ignoreTextPatterns: no plain glob"),
        F.when(
            F.exists(
                t["authorizedRedirectOrigins"],
                lambda o: urls.public_url_problem(o).isNotNull() | ~o.rlike("^(?i)https://[^/?#]+/?$"),
            ),
            "authorizedRedirectOrigins: no origin",
        ),
        F.when(F.exists(F.map_entries(t["productIdentifiers"]), _wrong_identifier), "productIdentifiers"),
    ]
    read = F.from_json("json", TARGET)
    made = rows.withColumn("target", read.withField("currency", F.upper(F.trim(read["currency"]))))
    return made.withColumn("problems", F.array_compact(F.array(*checks)))


def repeated_names(targets: DataFrame) -> DataFrame:
    """Names that more than one target has, letter case aside."""
    return (
        targets.groupBy(F.lower(F.trim("target.name")).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND name IS NOT NULL")
    )


#: Versions of stored snapshots and of the rules that make them; both are part of a target's identity.
STORAGE_VERSION, RULES_VERSION = 1, "1.0.0"


def identity_hash(targets: DataFrame) -> Column:
    """Hash of what identifies a target: the canonical JSON of its settings, keys in order.

    A null list is an empty one. The columns include_selectors and exclude_selectors may be absent.
    """

    def texts(name: str) -> Column:
        if name not in targets.columns:
            return F.lit("[]")
        safe = F.transform(F.col(name), lambda x: text.redact_emails(text.redact_secrets(x)))
        return F.coalesce(F.to_json(safe), F.lit("[]"))

    name = canon.json_string(text.redact(F.col("target_name"), text.MAX_TEXT))
    pieces = (
        ("changeTypes", texts("change_types")),
        ("excludeSelectors", texts("exclude_selectors")),
        ("ignoreTextPatterns", texts("ignore_text_patterns")),
        ("includeSelectors", texts("include_selectors")),
        ("normalizerVersion", F.lit(f'"{RULES_VERSION}"')),
        ("storageSchemaVersion", F.lit(str(STORAGE_VERSION))),
        ("targetName", F.coalesce(name, F.lit("null"))),
        ("targetUrl", F.coalesce(canon.json_string(urls.sorted_url(F.col("url"))), F.lit("null"))),
    )
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{key}":'), value) for key, value in pieces])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)
