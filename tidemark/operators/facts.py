"""Facts: production from wide rows, union of producers, first-wins, comparison of two versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import canon, numbers, text


def unpivot(df: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row (keys, field, value) per field of a wide row whose value is not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])
    return (
        df.select(*keys, F.posexplode(pairs).alias("ord", "pair"))
        .select(*keys, "ord", "pair.field", "pair.value")
        .filter(F.col("value").isNotNull())
    )


def union_producers(producers: list[DataFrame]) -> DataFrame:
    """All rows of the producers with their place in the list as ``producer``."""
    tagged = [p.withColumn("producer", F.lit(k)) for k, p in enumerate(producers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def in_order(col: Column | str) -> Column:
    """A text for sorting as dictionaries do: by letters first, then accents, then case (the root collation)."""
    return F.collate(F.col(col) if isinstance(col, str) else col, "UNICODE")


def first_wins(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """Per key the row that comes first by ``order``, which must be total.

    A minimum over a struct: partial aggregation collapses repeated keys before the shuffle, and
    no window has to hold a key's rows.
    """
    item = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *[F.col(c) for c in carry])
    return df.groupBy(*keys).agg(F.min(item).alias("first_")).select(*keys, *[F.col(f"first_.{c}") for c in carry])


def wanted(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts whose category their target wants."""
    wants = targets.select("target_identity", F.explode("change_types").alias("category")).distinct()
    return facts.join(wants, ["target_identity", "category"], "left_semi")


def compare(previous: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two versions: (keys, previous, current, change_kind) of what differs.

    Keys must be unique on each side (:func:`first_wins`). A null value is a value, so presence is
    told by flags and not by nulls.
    """
    p = previous.select(*keys, F.col(value).alias("previous"), F.lit(True).alias("in_previous"))
    c = current.select(*keys, F.col(value).alias("current"), F.lit(True).alias("in_current"))
    kind = (
        F.when(F.col("in_previous").isNull(), "added")
        .when(F.col("in_current").isNull(), "removed")
        .when(~F.col("previous").eqNullSafe(F.col("current")), "changed")
    )
    return (
        p.join(c, keys, "full_outer")
        .withColumn("change_kind", kind)
        .filter(F.col("change_kind").isNotNull())
        .drop("in_previous", "in_current")
    )


def with_deltas(changes: DataFrame) -> DataFrame:
    """Adds delta and delta_percent of numeric values, null for others."""
    p, c = F.col("previous").try_cast("double"), F.col("current").try_cast("double")
    return changes.withColumn("delta", numbers.delta(p, c)).withColumn(
        "delta_percent", numbers.percent(p, F.col("delta"))
    )


def merge_signals(previous: Column, current: Column) -> Column:
    """Signals of a pair: any of either side; a complete pair needs both sides complete."""
    names = ("structured", "stable_selector", "identifier_present", "multiple_sources", "pack_or_unit_known")
    either = [
        (F.coalesce(previous[n], F.lit(False)) | F.coalesce(current[n], F.lit(False))).alias(n) for n in names
    ]
    both = F.coalesce(previous["complete_pair"], F.lit(False)) & F.coalesce(current["complete_pair"], F.lit(False))
    return F.struct(*either, both.alias("complete_pair"))


def merge_sources(previous: Column, current: Column, limit: int = 10) -> Column:
    """Sorted union of two source lists, the first ``limit``."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_union(F.coalesce(previous, none), F.coalesce(current, none))), 1, limit)


def change_id(identity: Column, category: Column, field: Column, previous: Column, current: Column) -> Column:
    """Hash of the canonical JSON of a change; the two values are canonical JSON texts, null is JSON null."""
    value = lambda c: F.coalesce(c, F.lit("null"))
    name = lambda c: F.coalesce(canon.json_string(c), F.lit("null"))
    pieces = (
        ('{"category":', name(category)),
        (',"currentValue":', value(current)),
        (',"field":', name(field)),
        (',"previousValue":', value(previous)),
        (',"targetIdentityHash":', name(identity)),
    )
    return F.sha2(F.concat(*[x for key, text in pieces for x in (F.lit(key), text)], F.lit("}")), 256)


#: Bounds of a change: characters of an excerpt, sources.
EXCERPT, SOURCES = 300, 10


def change_rows(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between two versions of facts, one row each, with all that is told of a change.

    Rows have target_identity, fact_id, category, field_path, fact_value, evidence, sources and
    signals, unique by the first two on each side. Values are compared by their canonical JSON
    text, so another spelling is no change; a null value is JSON null and a value. Category and
    field are those of the current fact, or of the previous one if it was removed.
    """
    keys = ["target_identity", "fact_id"]
    carried = ["category", "field_path", "evidence", "sources", "signals"]

    def side(df: DataFrame, name: str) -> DataFrame:
        value = F.coalesce(canon.canonical_column(F.col("fact_value"))["text"], F.col("fact_value"), F.lit("null"))
        return df.select(*keys, F.struct(value.alias("value"), *carried).alias(name))

    both = side(previous, "p").join(side(current, "c"), keys, "full_outer")
    kind = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(
        F.col("p.value") != F.col("c.value"), "changed"
    )
    either = lambda f: F.when(F.col("c").isNull(), F.col(f"p.{f}")).otherwise(F.col(f"c.{f}"))
    rows = both.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull()).select(
        *keys,
        either("category").alias("category"),
        either("field_path").alias("field_path"),
        "change_kind",
        F.col("p.value").alias("previous"),
        F.col("c.value").alias("current"),
        F.nullif(text.redact(F.col("p.evidence"), EXCERPT), F.lit("")).alias("previous_excerpt"),
        F.nullif(text.redact(F.col("c.evidence"), EXCERPT), F.lit("")).alias("current_excerpt"),
        merge_sources(F.col("p.sources"), F.col("c.sources"), SOURCES).alias("sources"),
        merge_signals(F.col("p.signals"), F.col("c.signals")).alias("signals"),
    )
    ident = change_id(*[F.col(c) for c in ("target_identity", "category", "field_path", "previous", "current")])
    told = explanation(*[F.col(c) for c in ("category", "field_path", "change_kind", "delta", "delta_percent")])
    return with_deltas(rows).withColumn("change_id", ident).withColumn("explanation", told)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "place") -> DataFrame:
    """First ``limit`` rows per key; Spark limits each group before the shuffle."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(over)).filter(F.col(name) <= limit)


def explanation(category: Column, field: Column, kind: Column, difference: Column, percent: Column) -> Column:
    """One sentence on a change: what was added, removed, raised, lowered or changed, and where."""
    words = F.replace(category, F.lit("_"), F.lit(" "))
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000))
    share = F.when(percent.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(" ("), numbers.number_text(F.abs(percent)), F.lit("%)"))
    )
    moved = F.concat(
        label,
        F.when(difference > 0, " increased by ").otherwise(" decreased by "),
        numbers.number_text(F.abs(difference)),
        share,
        F.lit(" at "),
        field,
        F.lit("."),
    )
    return (
        F.when(kind == "added", F.concat(label, F.lit(" was added at "), field, F.lit(".")))
        .when(kind == "removed", F.concat(label, F.lit(" was removed from "), field, F.lit(".")))
        .when(difference.isNotNull(), moved)
        .otherwise(F.concat(label, F.lit(" changed at "), field, F.lit(".")))
    )
