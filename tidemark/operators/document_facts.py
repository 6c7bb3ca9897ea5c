"""Facts of extracted documents: one long relation from offers, plans, policies, changelog and text.

Each producer is a projection and an explode; they are united in a fixed order and the first fact
of an id wins. Values are JSON texts, so that equality is equality of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import facts

#: A feature states a limit as a number and a name.
LIMIT = rf"{text.B}([0-9][0-9,.]*)\s+([A-Za-z][A-Za-z0-9 -]{{1,40}}){text.E}"


def quoted(col: Column) -> Column:
    """JSON text of a string."""
    return F.substring(F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}), 6, 2_000_000).substr(
        F.lit(1), F.length(F.to_json(F.struct(col.alias("v")))) - 6
    )


def _fact(kind: Column, category: str, field: Column, value: Column, evidence: Column, source: str) -> Column:
    return F.struct(
        kind.alias("fact_id"),
        F.lit(category).alias("category"),
        field.alias("field_path"),
        value.alias("fact_value"),
        evidence.alias("evidence"),
        F.lit(source).alias("source"),
    )


def _when(value: Column, fact: Column) -> Column:
    return F.when(value.isNotNull(), fact)


def _exploded(df: DataFrame, made: list[Column]) -> DataFrame:
    return (
        df.select("target_identity", "ord_", F.posexplode(F.array(*made)).alias("at_", "f"))
        .filter(F.col("f").isNotNull())
        .select("target_identity", "ord_", "at_", "f.*")
    )


def product_facts(documents: DataFrame, currency: Column) -> DataFrame:
    rows = documents.select("target_identity", currency.alias("fallback"), F.posexplode("document.product_offers").alias("ord_", "o"))
    position = F.concat(F.lit("product-"), F.col("ord_") + 1)
    source = F.coalesce(*[F.col(f"o.{n}") for n in ("sku", "gtin", "mpn", "model", "name")], position)
    ident = text.slug(F.coalesce(F.nullif(text.model_id(source), F.lit("")), position))
    rows = rows.select(
        "target_identity",
        "ord_",
        ident.alias("id"),
        F.coalesce(F.col("o.name"), ident).alias("name"),
        numbers.decimal(F.col("o.price")).alias("price"),
        F.coalesce(
            text.currency(F.coalesce(F.col("o.priceCurrency"), F.col("o.price"), F.lit(""))), F.upper("fallback")
        ).alias("currency"),
        text.availability(F.col("o.availability")).alias("stock"),
    ).withColumn("stock", F.when(F.col("stock") != "unknown", F.col("stock")))
    priced = F.concat_ws(" ", F.concat("name", F.lit(":")), "currency", numbers.number_text(F.col("price")))
    told = lambda c: F.concat("name", F.lit(": "), c)
    one = lambda name, category, value, evidence: _fact(
        F.concat(F.lit("product:"), "id", F.lit(f":{name}")),
        category,
        F.concat(F.lit("product."), "id", F.lit(f".{name}")),
        value,
        evidence,
        "json_ld",
    )
    return _exploded(
        rows,
        [
            _when(F.col("price"), one("price", "price", numbers.number_text(F.col("price")), priced)),
            _when(F.col("currency"), one("currency", "price", quoted(F.col("currency")), told("currency"))),
            _when(F.col("stock"), one("availability", "availability", quoted(F.col("stock")), told("stock"))),
        ],
    )


def plan_facts(documents: DataFrame, patterns: Column | None = None) -> DataFrame:
    """Facts of plans. Plans of one name share the evidence of the first of them."""
    noise = F.lit(None).cast("array<string>") if patterns is None else patterns
    rows = documents.select(
        "target_identity",
        noise.alias("patterns_"),
        F.exists("document.product_offers", lambda o: numbers.decimal(o["price"]).isNotNull()).alias("priced"),
        F.posexplode("document.pricing_plans").alias("ord_", "p"),
    )
    # A feature holds one line; lines are joined so that noise is suppressed once for a plan.
    joined = F.split(text.suppress_lines(F.array_join(F.transform("p.features", text.collapse), "\n"), F.col("patterns_")), "\n")
    features = F.array_sort(F.filter(joined, lambda f: f != ""))
    rows = rows.select(
        "target_identity",
        "ord_",
        "priced",
        text.slug(F.col("p.name")).alias("id"),
        F.col("p.evidence").alias("evidence_"),
        numbers.decimal(F.coalesce("p.price_text", F.lit(""))).alias("price"),
        text.unit(F.col("p.price_text")).alias("interval"),
        F.when(F.col("p.availability_text").isNotNull(), text.availability(F.col("p.availability_text"))).alias("stock"),
        features.alias("features"),
    )
    first = Window.partitionBy("target_identity", "id").orderBy("ord_")
    rows = rows.withColumn("evidence", F.first("evidence_").over(first)).drop("evidence_")
    shown = F.when(~F.col("priced"), F.col("price"))
    one = lambda name, category, field, value: _fact(
        F.concat(F.lit("plan:"), "id", F.lit(f":{name}")),
        category,
        F.concat(F.lit("pricingPlan."), "id", F.lit(f".{field}")),
        value,
        F.col("evidence"),
        "pricing_selector",
    )
    fixed = _exploded(
        rows,
        [
            one("exists", "pricing_plan", "exists", F.lit("true")),
            _when(shown, one("price", "price", "price", numbers.number_text(shown))),
            _when(F.col("interval"), one("billing", "pricing_plan", "billingInterval", quoted(F.col("interval")))),
            one("features", "product_feature", "features", F.to_json("features")),
            _when(F.col("stock"), one("availability", "availability", "availability", quoted(F.col("stock")))),
        ],
    )
    limits = (
        rows.select("target_identity", "ord_", "id", "evidence", F.posexplode("features").alias("n", "feature"))
        .filter(F.col("feature").rlike(LIMIT))
        .select(
            "target_identity",
            "ord_",
            "id",
            "evidence",
            "n",
            text.slug(F.regexp_extract("feature", LIMIT, 2)).alias("name"),
            numbers.decimal(F.regexp_extract("feature", LIMIT, 1)).alias("value"),
        )
        .filter("value IS NOT NULL")
        # The last feature of a name states its limit.
        .groupBy("target_identity", "ord_", "id", "name")
        .agg(F.max_by("value", "n").alias("value"), F.min("evidence").alias("evidence"))
    )
    mined = limits.select(
        "target_identity",
        "ord_",
        F.lit(100).alias("at_"),
        F.concat(F.lit("plan:"), "id", F.lit(":limit:"), "name").alias("fact_id"),
        F.lit("pricing_plan").alias("category"),
        F.concat(F.lit("pricingPlan."), "id", F.lit(".limit."), "name").alias("field_path"),
        numbers.number_text(F.col("value")).alias("fact_value"),
        "evidence",
        F.lit("pricing_selector").alias("source"),
    )
    return fixed.unionByName(mined)


def section_facts(
    documents: DataFrame, column: str, prefix: str, category: str, fallback: str, second: str, patterns: Column | None = None
) -> DataFrame:
    """Facts of policies or changelog entries: the text without noise, and its effective date or version."""
    noise = F.lit(None).cast("array<string>") if patterns is None else patterns
    rows = documents.select(
        "target_identity", noise.alias("patterns_"), F.posexplode(f"document.{column}").alias("ord_", "s")
    ).select("target_identity", "patterns_", "ord_", "s.heading", "s.text")
    return section_row_facts(rows, prefix, category, fallback, second)


def section_row_facts(rows: DataFrame, prefix: str, category: str, fallback: str, second: str) -> DataFrame:
    """:func:`section_facts` of rows (target_identity, patterns_, ord_, heading, text), ``ord_`` counted from 0."""
    ident = text.slug(F.coalesce("heading", F.concat(F.lit(f"{fallback}-"), F.col("ord_") + 1)))
    rows = (
        rows.filter("text IS NOT NULL")
        .select(
            "target_identity",
            "ord_",
            ident.alias("id"),
            text.suppress_noise(F.col("text"), F.col("patterns_")).alias("text"),
        )
        .filter("text != ''")
        .withColumn("extra", dates.extract(F.col("text")) if second == "effectiveDate" else text.version(F.col("text")))
    )
    key = {"effectiveDate": "effective-date"}.get(second, second)
    made = [
        _fact(
            F.concat(F.lit(f"{prefix}:"), "id", F.lit(f":{k}")),
            category,
            F.concat(F.lit(f"{prefix}."), "id", F.lit(f".{field}")),
            quoted(F.col(c)),
            F.col("text"),
            f"{prefix}_selector",
        )
        for k, field, c in (("text", "text", "text"), (key, second, "extra"))
    ]
    return _exploded(rows, [made[0], _when(F.col("extra"), made[1])])


def text_facts(documents: DataFrame, patterns: Column | None = None) -> DataFrame:
    """One fact with the hash of the whole text without noise."""
    body = text.suppress_noise(F.col("document.visible_text"), patterns)
    return documents.select("target_identity", body.alias("body_")).filter("body_ != ''").select(
        "target_identity",
        F.lit(0).alias("ord_"),
        F.lit(0).alias("at_"),
        F.lit("page:general-content").alias("fact_id"),
        F.lit("general_content").alias("category"),
        F.lit("page.generalContentHash").alias("field_path"),
        quoted(F.sha2("body_", 256)).alias("fact_value"),
        F.substring("body_", 1, 2_000).alias("evidence"),
        F.lit("visible_text").alias("source"),
    )


#: Kinds of sections: the column of documents, and what their facts are called by.
SECTIONS = {
    "policy": ("policies", ("policy", "terms_policy", "section", "effectiveDate")),
    "changelog": ("changelog", ("changelog", "launch_changelog", "entry", "version")),
}


def document_facts(
    documents: DataFrame, currency: Column | None = None, patterns: Column | None = None, sections: DataFrame | None = None
) -> DataFrame:
    """All facts of rows (target_identity, document), the first of each id.

    ``patterns`` are the globs that a target ignores: what they match never makes a fact differ.
    Documents without parts, and null documents, have no facts. ``sections`` are rows of
    :func:`section_row_facts` with their section_kind, in place of those that documents hold in
    arrays: then no row grows with the number of a document's sections.
    """

    def of_kind(kind: str) -> DataFrame:
        column, names = SECTIONS[kind]
        if sections is None:
            return section_facts(documents, column, *names, patterns)
        return section_row_facts(sections.filter(F.col("section_kind") == kind), *names)

    producers = [
        product_facts(documents, F.lit(None).cast("string") if currency is None else currency),
        plan_facts(documents, patterns),
        of_kind("policy"),
        of_kind("changelog"),
        text_facts(documents, patterns),
    ]
    rows = facts.union_producers(producers)
    order = [F.col("producer"), F.col("ord_"), F.col("at_")]
    return facts.first_wins(
        rows, ["target_identity", "fact_id"], order, ["category", "field_path", "fact_value", "evidence", "source"]
    )
