"""Queries of the engine's own operators, each over its whole tables, with equivalent SQL.

Names of columns are the same on both sides; instants are given as microseconds or text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import canon, dates, net, numbers, text, urls
from tidemark.operators import deliveries, document_facts, facts, history, reports
from tidemark.session import spread, table
from tidemark.sources import config
from tidemark.sources import documents as docs
from tidemark.streaming import weekly

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- SQL of what many queries share

_SPACE = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'), ' ')"


def _sql_secrets(x: str) -> str:
    """SQL that hides secrets and addresses, in the order of the shapes."""
    shapes = (
        ("(?i)\\b(bearer|basic)\\s+[a-z0-9._~+/=:-]+", "\\1 [REDACTED]"),
        ("(?i)([?&](?:token|access_token|api[_-]?key|key|secret|signature|sig|password|session)=)[^&#\\s]+", "\\1[REDACTED]"),
        ("\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}(?:\\.[A-Za-z0-9_-]{8,})?\\b", "[REDACTED]"),
        ("(?i)\\b(?:sk|pk|ghp|github_pat|xox[baprs])[-_A-Za-z0-9]{12,}\\b", "[REDACTED]"),
        ("(?i)\\b(password|passwd|secret|api[-_]?key|access[-_]?token|token|session|signature|sig)\\s*[:=]\\s*[^\\s,;]+", "\\1=[REDACTED]"),
        ("(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b", "[REDACTED_EMAIL]"),
    )
    x = f"replace(nfc_normalize({x}), chr(13) || chr(10), chr(10))"
    for shape, by in shapes:
        x = f"regexp_replace({x}, '{shape}', '{by}', 'g')"
    return x


def _sql_redact(x: str, limit: int = 50_000) -> str:
    """SQL of the whole redaction: phone numbers are the runs of 10 to 15 digits with a separator that are no date."""
    digits = "length(regexp_replace(c, '[^0-9]', '', 'g'))"
    phone = (
        f"NOT regexp_full_match(trim(c), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {digits} BETWEEN 10 AND 15"
        " AND NOT regexp_full_match(trim(c), '[0-9]+')"
    )
    runs = "regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])(\\+?[0-9][0-9 ().-]{6,}[0-9])(?:$|[^A-Za-z0-9_])', 1)"
    return (
        f"(SELECT left(trim(list_reduce(list_prepend(t, {runs}), lambda acc, c: CASE WHEN {phone} THEN replace(acc, c, '[REDACTED_PHONE]')"
        f" ELSE acc END), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || chr(8232) || chr(8233)"
        f" || chr(8239) || chr(8287) || chr(12288) || chr(65279)), {limit}) FROM (SELECT {_sql_secrets(x)} AS t))"
    )


def _sql_globs(x: str, patterns: str) -> str:
    """SQL that puts a blank for what the first ten globs match."""
    safe = "regexp_replace(p, '([.+^${}()|\\[\\]\\\\])', '\\\\\\1', 'g')"
    return (
        f"list_reduce(list_prepend({x}, coalesce({patterns}[1:10], [])), lambda acc, p:"
        f" regexp_replace(acc, replace(replace({safe}, '?', '.'), '*', '.{{0,500}}?'), ' ', 'gis'))"
    )


def _sql_noise(x: str, patterns: str) -> str:
    """SQL of the suppression of noise, redaction included."""
    x = _sql_collapse(f"nfc_normalize({x})")
    for shape, by in (
        ("(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\b", "[volatile-id]"),
        ("(?i)\\b(?:session|request|render|cache)[ _-]?(?:id|key|token)\\s*[:=]\\s*[A-Za-z0-9._-]{6,}\\b", "[volatile-id]"),
        ("(?i)\\b(?:page\\s+rendered|generated|rendered)\\s+(?:at|on)\\s+[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.+-]+(?:Z|UTC)?\\b", "[render-time]"),
    ):
        x = f"regexp_replace({x}, '{shape}', '{by}', 'g')"
    return _sql_redact(_sql_collapse(_sql_globs(x, patterns)))


#: Canonical JSON of fact values, which are constants, numbers, strings and arrays of strings.
_CANONICAL = f"""CASE WHEN fact_value IS NULL THEN NULL WHEN NOT json_valid(fact_value) THEN fact_value
    WHEN json_type(fact_value) = 'VARCHAR' THEN CAST(to_json({_sql_redact("(fact_value ->> '$')")}) AS VARCHAR)
    WHEN json_type(fact_value) = 'ARRAY' THEN CAST(to_json(list_transform(from_json(fact_value, '["VARCHAR"]'), lambda e: nfc_normalize(e))) AS VARCHAR)
    WHEN json_type(fact_value) IN ('BOOLEAN', 'NULL') THEN trim(fact_value)
    ELSE regexp_replace(CAST(CAST(trim(fact_value) AS DOUBLE) + 0.0 AS VARCHAR), '\\.0$', '') END"""


# ---------------------------------------------------------------- facts


@query("""
    SELECT p_partkey, 0 AS ord, 'price' AS field, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS value FROM part WHERE p_retailprice IS NOT NULL
    UNION ALL SELECT p_partkey, 1, 'brand', p_brand FROM part WHERE p_brand IS NOT NULL
    UNION ALL SELECT p_partkey, 2, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size IS NOT NULL""")
def fact_unpivot(spark, d):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    fields = {"price": cents, "brand": F.col("p_brand"), "size": F.col("p_size")}
    return facts.unpivot(table(spark, d, "part"), ["p_partkey"], fields)


@query("""
    SELECT producer, field, count(*) AS n FROM (
        SELECT 0 AS producer, unnest(['name', 'brand']) AS field FROM part
        UNION ALL SELECT 1, unnest(['name']) FROM supplier)
    GROUP BY producer, field""")
def fact_union_producers(spark, d):
    parts = facts.unpivot(
        table(spark, d, "part").withColumnRenamed("p_partkey", "k"), ["k"], {"name": F.col("p_name"), "brand": F.col("p_brand")}
    )
    suppliers = facts.unpivot(table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k"), ["k"], {"name": F.col("s_name")})
    return facts.union_producers([parts, suppliers]).groupBy("producer", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT target_identity, generation, fact_id, fact_row, category FROM facts
    QUALIFY row_number() OVER (PARTITION BY target_identity, generation, fact_id ORDER BY ord, fact_row) = 1""")
def fact_first_wins(spark, d):
    return facts.first_wins(
        table(spark, d, "facts"),
        ["target_identity", "generation", "fact_id"],
        [F.col("ord"), F.col("fact_row")],
        ["fact_row", "category"],
    )


@query("""
    SELECT f.category, count(*) AS n, count(DISTINCT f.target_identity) AS targets FROM facts f
    WHERE EXISTS (SELECT 1 FROM targets t WHERE t.target_identity = f.target_identity AND list_contains(t.change_types, f.category))
    GROUP BY f.category""")
def fact_wanted_types(spark, d):
    kept = facts.wanted(table(spark, d, "facts"), table(spark, d, "targets"))
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_identity").alias("targets"))


def _two_versions(spark, d):
    """Facts of each target's first and last trusted generation, the lowest ord of each."""
    m = table(spark, d, "manifests").filter("manifest_kind = 'trusted'")
    ends = m.groupBy("target_identity").agg(
        F.min_by("generation", "created_at").alias("old"), F.max_by("generation", "created_at").alias("new")
    )
    ends = ends.filter("old <> new")
    both = ends.select("target_identity", F.explode(F.array("old", "new")).alias("generation"))
    f = facts.first_wins(
        # Facts of other generations are dropped before the aggregate.
        table(spark, d, "facts").join(both, ["target_identity", "generation"], "left_semi"),
        ["target_identity", "generation", "fact_id"],
        [F.col("ord"), F.col("fact_row")],
        ["fact_value", "category", "sources", "signals", "field_path", "evidence"],
    )
    return f.join(ends.select("target_identity", F.col("old").alias("generation")), ["target_identity", "generation"], "left_semi"), f.join(
        ends.select("target_identity", F.col("new").alias("generation")), ["target_identity", "generation"], "left_semi"
    )


_ENDS = """
    WITH e AS (SELECT target_identity, arg_min(generation, created_at) AS old, arg_max(generation, created_at) AS new
               FROM manifests WHERE manifest_kind = 'trusted' GROUP BY target_identity),
    f AS (SELECT x.*, e.old, e.new FROM (
              SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY target_identity, generation, fact_id ORDER BY ord, fact_row) = 1
          ) x JOIN e USING (target_identity) WHERE e.old <> e.new),
    p AS (SELECT * FROM f WHERE generation = old), c AS (SELECT * FROM f WHERE generation = new)"""


@query(_ENDS + """
    SELECT coalesce(p.target_identity, c.target_identity) AS target_identity, coalesce(p.fact_id, c.fact_id) AS fact_id,
           CASE WHEN p.fact_id IS NULL THEN 'added' WHEN c.fact_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
           p.fact_value AS previous, c.fact_value AS current
    FROM p FULL OUTER JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id
    WHERE p.fact_id IS NULL OR c.fact_id IS NULL OR p.fact_value IS DISTINCT FROM c.fact_value""")
def snapshot_diff(spark, d):
    old, new = _two_versions(spark, d)
    return facts.compare(old, new, ["target_identity", "fact_id"], "fact_value")


@query(_ENDS + """, n AS (
        SELECT p.target_identity, p.fact_id, try_cast(p.fact_value AS DOUBLE) AS a, try_cast(c.fact_value AS DOUBLE) AS b
        FROM p JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id WHERE p.fact_value <> c.fact_value),
    k AS (SELECT *, floor((b - a) * 10000 + 0.5) / 10000 AS delta FROM n WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT target_identity, fact_id, delta,
           CASE WHEN a <> 0 THEN floor(delta / a * 100 * 10000 + 0.5) / 10000 END AS delta_percent FROM k""")
def price_delta(spark, d):
    old, new = _two_versions(spark, d)
    changed = facts.compare(old, new, ["target_identity", "fact_id"], "fact_value").filter("change_kind = 'changed'")
    return facts.with_deltas(changed).filter("delta IS NOT NULL").select("target_identity", "fact_id", "delta", "delta_percent")


@query(_ENDS + """
    SELECT p.target_identity, p.fact_id,
           list_aggregate(list_slice(list_sort(list_distinct(list_concat(coalesce(p.sources, []), coalesce(c.sources, [])))), 1, 10), 'string_agg', ',') AS sources
    FROM p JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id""")
def source_union(spark, d):
    old, new = _two_versions(spark, d)
    keys = ["target_identity", "fact_id"]
    both = old.select(*keys, F.col("sources").alias("a")).join(new.select(*keys, F.col("sources").alias("b")), keys)
    return both.select(*keys, F.nullif(F.array_join(facts.merge_sources(F.col("a"), F.col("b")), ","), F.lit("")).alias("sources"))


@query(_ENDS + """
    SELECT p.target_identity, p.fact_id,
           coalesce(p.signals.structured, false) OR coalesce(c.signals.structured, false) AS structured,
           coalesce(p.signals.identifier_present, false) OR coalesce(c.signals.identifier_present, false) AS identifier_present,
           coalesce(p.signals.complete_pair, false) AND coalesce(c.signals.complete_pair, false) AS complete_pair
    FROM p JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id""")
def signal_merge(spark, d):
    old, new = _two_versions(spark, d)
    keys = ["target_identity", "fact_id"]
    both = old.select(*keys, F.col("signals").alias("a")).join(new.select(*keys, F.col("signals").alias("b")), keys)
    merged = both.withColumn("s", facts.merge_signals(F.col("a"), F.col("b")))
    return merged.select(*keys, "s.structured", "s.identifier_present", "s.complete_pair")


@query(f"""
    SELECT fact_row, sha256('{{"category":' || coalesce(CAST(to_json(category) AS VARCHAR), 'null') || ',"currentValue":' || coalesce({_CANONICAL}, 'null') ||
           ',"field":' || coalesce(CAST(to_json(field_path) AS VARCHAR), 'null') || ',"previousValue":null,"targetIdentityHash":' ||
           coalesce(CAST(to_json(target_identity) AS VARCHAR), 'null') || '}}') AS change_id FROM facts""")
def change_id(spark, d):
    """Id of the change that a fact is when it is new."""
    value = F.coalesce(canon.canonical_column(F.col("fact_value"))["text"], F.col("fact_value"))
    made = facts.change_id(F.col("target_identity"), F.col("category"), F.col("field_path"), F.lit(None).cast("string"), value)
    return table(spark, d, "facts").select("fact_row", made.alias("change_id"))


@query(_ENDS.replace("SELECT x.*, e.old", f"SELECT x.*, {_CANONICAL} AS v, e.old") + """,
    k AS (SELECT coalesce(c.target_identity, p.target_identity) AS target_identity, coalesce(c.fact_id, p.fact_id) AS fact_id,
                 CASE WHEN c.fact_id IS NULL THEN p.category ELSE c.category END AS category, CASE WHEN c.fact_id IS NULL THEN p.field_path ELSE c.field_path END AS field_path,
                 CASE WHEN p.fact_id IS NULL THEN 'added' WHEN c.fact_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
                 CASE WHEN p.fact_id IS NOT NULL THEN coalesce(p.v, 'null') END AS previous, CASE WHEN c.fact_id IS NOT NULL THEN coalesce(c.v, 'null') END AS current,
                 nullif(""" + _sql_redact("p.evidence", 300) + """, '') AS previous_excerpt, nullif(""" + _sql_redact("c.evidence", 300) + """, '') AS current_excerpt
          FROM p FULL OUTER JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id
          WHERE p.fact_id IS NULL OR c.fact_id IS NULL OR coalesce(p.v, 'null') <> coalesce(c.v, 'null'))
    SELECT *, sha256('{"category":' || coalesce(CAST(to_json(category) AS VARCHAR), 'null') || ',"currentValue":' || coalesce(current, 'null') || ',"field":' ||
           coalesce(CAST(to_json(field_path) AS VARCHAR), 'null') || ',"previousValue":' || coalesce(previous, 'null') || ',"targetIdentityHash":' ||
           CAST(to_json(target_identity) AS VARCHAR) || '}') AS change_id FROM k""")
def change_rows(spark, d):
    old, new = _two_versions(spark, d)
    return facts.change_rows(old, new).select(
        "target_identity", "fact_id", "category", "field_path", "change_kind", "previous", "current", "previous_excerpt", "current_excerpt", "change_id"
    )


_SAFE_LIST = "coalesce(CAST(to_json({0}) AS VARCHAR), '[]')"


@query(f"""
    SELECT target_identity, sha256('{{"changeTypes":' || {_SAFE_LIST.format('change_types')} || ',"excludeSelectors":[],"ignoreTextPatterns":' ||
           {_SAFE_LIST.format('ignore_text_patterns')} || ',"includeSelectors":[],"normalizerVersion":"1.0.0","storageSchemaVersion":1,"targetName":' ||
           coalesce(CAST(to_json({_sql_redact('target_name')}) AS VARCHAR), 'null') || ',"targetUrl":' ||
           coalesce(CAST(to_json(regexp_replace(url, '#.*$', '')) AS VARCHAR), 'null') || '}}') AS identity_hash FROM targets""")
def target_identity_hash(spark, d):
    t = table(spark, d, "targets")
    return t.select("target_identity", config.identity_hash(t).alias("identity_hash"))


@query("""
    SELECT target_identity, generation, fact_id, row_number() OVER (PARTITION BY target_identity, generation ORDER BY fact_id COLLATE en, fact_id) AS place
    FROM (SELECT DISTINCT target_identity, generation, fact_id FROM facts)""")
def fact_order(spark, d):
    """Facts of a snapshot in dictionary order, as they are stored."""
    from pyspark.sql import Window

    over = Window.partitionBy("target_identity", "generation").orderBy(facts.in_order("fact_id"), "fact_id")
    keys = table(spark, d, "facts").select("target_identity", "generation", "fact_id").distinct()
    return keys.withColumn("place", F.row_number().over(over))


@query("""
    SELECT target_identity, generation, count(*) AS facts, count(DISTINCT fact_id) AS ids, count(DISTINCT category) AS categories,
           count(*) FILTER (WHERE fact_value IS NULL) AS null_values, max(ord) AS last_ord
    FROM facts GROUP BY target_identity, generation""")
def snapshot_sizes(spark, d):
    return table(spark, d, "facts").groupBy("target_identity", "generation").agg(
        F.count(F.lit(1)).alias("facts"),
        F.countDistinct("fact_id").alias("ids"),
        F.countDistinct("category").alias("categories"),
        F.count_if(F.col("fact_value").isNull()).alias("null_values"),
        F.max("ord").alias("last_ord"),
    )


# ---------------------------------------------------------------- digests and reports

_RANK = "CASE severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_ORDER = f"{_RANK} DESC NULLS LAST, confidence_score DESC NULLS LAST, target_name COLLATE en ASC NULLS LAST, field_path COLLATE en ASC NULLS LAST, change_row"
_UNIQUE = "(SELECT * FROM digest_changes WHERE change_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY change_row) = 1)"


@query(f"SELECT change_id, change_row FROM {_UNIQUE}")
def digest_first_wins(spark, d):
    return reports.unique_changes(table(spark, d, "digest_changes")).select("change_id", "change_row")


@query(f"SELECT change_id, change_row, severity, confidence_score, target_name, field_path FROM {_UNIQUE} ORDER BY {_ORDER} LIMIT 100")
def digest_top100(spark, d):
    return reports.digest(table(spark, d, "digest_changes")).select(
        "change_id", "change_row", "severity", "confidence_score", "target_name", "field_path"
    )


_UNIQUE_IN = "(SELECT * FROM digest_changes WHERE change_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY payload_row, change_id ORDER BY change_row) = 1)"


@query(f"""
    SELECT payload_row, change_row, row_number() OVER (PARTITION BY payload_row ORDER BY {_ORDER}) AS place FROM {_UNIQUE_IN}
    QUALIFY place <= 10""")
def webhook_top10(spark, d):
    return reports.payloads(table(spark, d, "digest_changes"), "payload_row").select("payload_row", "change_row", "place")


@query(f"""
    SELECT change_row, {_sql_redact('target_name', 100)} AS target_name, {_sql_redact('field_path', 256)} AS field_path, {_sql_redact('explanation', 300)} AS explanation,
           nullif({_sql_redact('previous_excerpt', 240)}, '') AS previous_excerpt, nullif({_sql_redact('current_excerpt', 240)}, '') AS current_excerpt
    FROM digest_changes""")
def digest_projection(spark, d):
    rows = reports.digest_rows(spread(table(spark, d, "digest_changes")))
    return rows.select("change_row", "target_name", "field_path", "explanation", "previous_excerpt", "current_excerpt")


@query(f"SELECT count(*) AS n, count(DISTINCT target_url) AS targets FROM digest_changes WHERE {_RANK} >= 2")
def materiality(spark, d):
    kept = reports.material(table(spark, d, "digest_changes"), "medium")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_url").alias("targets"))


@query("""
    SELECT payload_row, count(*) AS change_count, coalesce(arg_max(severity, """ + _RANK + """), 'informational') AS highest_severity,
           CAST(coalesce(floor(avg(confidence_score) + 0.5), 0) AS BIGINT) AS overall_confidence FROM digest_changes GROUP BY payload_row""")
def report_rollup(spark, d):
    return reports.rollup(table(spark, d, "digest_changes"), "payload_row")


@query(f"""
    WITH r AS (SELECT coalesce(arg_max(severity, {_RANK}), 'informational') AS highest_severity FROM digest_changes GROUP BY payload_row)
    SELECT v.highest_severity, count(r.highest_severity) AS n FROM (SELECT unnest(['informational', 'low', 'medium', 'high', 'critical']) AS highest_severity) v
    LEFT JOIN r USING (highest_severity) GROUP BY v.highest_severity""")
def severity_zero_fill(spark, d):
    """Reports by their highest severity, 0 for those that none has."""
    of_reports = reports.rollup(table(spark, d, "digest_changes"), "payload_row")
    return reports.zero_filled(of_reports, "highest_severity", reports.SEVERITIES)


@query("""
    SELECT check_status, n, row_number() OVER (ORDER BY check_status COLLATE en NULLS LAST) AS place
    FROM (SELECT check_status, count(DISTINCT entry_id) AS n FROM evidence_history GROUP BY check_status)""")
def status_counts(spark, d):
    """Counts of the statuses in dictionary order; the few counts are ordered after the aggregation."""
    counts = table(spark, d, "evidence_history").groupBy("check_status").agg(F.countDistinct("entry_id").alias("n"))
    order = [facts.in_order("check_status").asc_nulls_last()]
    return facts.top_per_group(counts.withColumn("all_", F.lit(0)), ["all_"], order, 1_000).select("check_status", "n", "place")


@query("""
    SELECT 'trusted-baseline-v1-manifest-' || target_identity AS trusted_key,
           'candidate-baseline-v1-manifest-' || target_identity || '-' || left(sha256(candidate_id), 24) AS candidate_key,
           'candidate-' || left(regexp_replace(strftime(timezone('UTC', created_at), '%Y-%m-%d %H:%M:%S'), '[^0-9]', '', 'g'), 14) || '-' || left(regexp_replace(generation, '[^A-Za-z0-9_-]', '', 'g'), 24) AS candidate_name
    FROM manifests WHERE manifest_kind = 'candidate'""")
def stored_keys(spark, d):
    m = table(spark, d, "manifests").filter("manifest_kind = 'candidate'")
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return m.select(
        canon.manifest_key(F.col("target_identity")).alias("trusted_key"),
        canon.manifest_key(F.col("target_identity"), F.col("candidate_id")).alias("candidate_key"),
        canon.candidate_name(at, F.col("generation")).alias("candidate_name"),
    )


@query("""
    SELECT DISTINCT destination_hash, 'weekly-digest-v1-' || left(sha256('{"destinationHash":' || CAST(to_json(destination_hash) AS VARCHAR) || ',"timezone":"UTC","deliveryDay":1}'), 40) AS state_key
    FROM webhook_payloads WHERE destination_hash IS NOT NULL""")
def weekly_keys(spark, d):
    p = table(spark, d, "webhook_payloads").filter("destination_hash IS NOT NULL").select("destination_hash").distinct()
    return p.select("destination_hash", canon.weekly_key(F.col("destination_hash"), F.lit("UTC"), F.lit(1)).alias("state_key"))


_CELL = """'"' || replace(CASE WHEN regexp_matches(coalesce({0}, ''), '^\\s*[=+@-]') THEN '\'\'' || {0} ELSE coalesce({0}, '') END, '"', '""') || '"'"""
_REVIEW = ("destination_hash", "run_url", "delivery_mode", "generated_at", "category", "field_path", "previous_excerpt", "current_excerpt", "NULL", "severity", "confidence_score")


@query(f"""
    SELECT 0 AS part, NULL::BIGINT AS report, NULL::BIGINT AS line_no, '{",".join(f'"{c}"' for c in (*reports.REVIEW_REPORT, *reports.REVIEW_CHANGE))}' AS line
    UNION ALL SELECT 1, p.payload_row, c.change_row, {" || ',' || ".join(_CELL.format(f"CAST({c} AS VARCHAR)") for c in _REVIEW)}
    FROM webhook_payloads p LEFT JOIN digest_changes c USING (payload_row)""")
def review_rows(spark, d):
    """A review file of all payloads: header, a line per change, and one for payloads without changes."""
    p = table(spark, d, "webhook_payloads").select(
        "payload_row", F.col("destination_hash").alias("target_name"), F.col("run_url").alias("target_url"), F.col("delivery_mode").alias("status"), F.col("generated_at").alias("checked_at")
    )
    c = table(spark, d, "digest_changes").select(
        "payload_row", "change_row", "category", "field_path", F.col("previous_excerpt").alias("previous"), F.col("current_excerpt").alias("current"),
        F.lit(None).cast("double").alias("delta_percent"), "severity", "confidence_score",
    )
    return reports.review_lines(p, c, "payload_row")


def _md(column: str) -> str:
    return f"regexp_replace({column}, '([\\\\`*_{{}}\\[\\]()#+.!|>-])', '\\\\\\1', 'g')"


@query(f"""
    WITH u AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM {_UNIQUE})
    SELECT place, '## ' || place || '. ' || {_md('target_name')} || ' - ' || {_md('severity')} || chr(10) || chr(10) || '- Field: ' ||
           {_md('field_path')} || chr(10) || '- Confidence: ' || confidence_score || '/100' || chr(10) || '- Source: ' || target_url || chr(10) AS section
    FROM u WHERE place <= 50""")
def markdown_lines(spark, d):
    return reports.markdown_sections(table(spark, d, "digest_changes"))


@query(f"""
    WITH u AS (SELECT DISTINCT c.change_id, p.destination_hash FROM digest_changes c JOIN webhook_payloads p USING (payload_row) WHERE c.change_id IS NOT NULL),
    s AS (SELECT change_id, {_RANK} AS rank, confidence_score FROM {_UNIQUE})
    SELECT destination_hash, change_id, row_number() OVER (PARTITION BY destination_hash ORDER BY rank DESC NULLS LAST, confidence_score DESC NULLS LAST, change_id) AS place
    FROM u JOIN s USING (change_id) QUALIFY place <= 100""")
def pending_top100(spark, d):
    changes, payloads = table(spark, d, "digest_changes"), table(spark, d, "webhook_payloads")
    seen = (
        changes.filter("change_id IS NOT NULL")
        .select("change_id", "payload_row")
        .join(payloads.select("payload_row", "destination_hash"), "payload_row")
        .select("change_id", "destination_hash")
        .distinct()
    )
    scored = reports.unique_changes(changes).select("change_id", reports.severity_rank(F.col("severity")).alias("rank"), "confidence_score")
    order = [F.col("rank").desc_nulls_last(), F.col("confidence_score").desc_nulls_last(), F.col("change_id")]
    top = facts.top_per_group(seen.join(scored, "change_id"), ["destination_hash"], order, weekly.PENDING)
    return top.select("destination_hash", "change_id", "place")


@query("""
    SELECT destination_hash, delivery_mode, count(*) AS payloads, sum(total_eligible_changes) AS changes,
           max(total_eligible_changes) AS most FROM webhook_payloads GROUP BY destination_hash, delivery_mode""")
def payload_totals(spark, d):
    return table(spark, d, "webhook_payloads").groupBy("destination_hash", "delivery_mode").agg(
        F.count(F.lit(1)).alias("payloads"),
        F.sum("total_eligible_changes").alias("changes"),
        F.max("total_eligible_changes").alias("most"),
    )


# ---------------------------------------------------------------- history and state


_KINDS = "['price', 'availability', 'product_feature', 'pricing_plan', 'terms_policy', 'launch_changelog', 'general_content']"
_IDS = "[{'k': 'sku', 'a': 1, 'b': 128}, {'k': 'gtin', 'a': 8, 'b': 14}, {'k': 'mpn', 'a': 1, 'b': 128}, {'k': 'brand', 'a': 1, 'b': 128}, {'k': 'model', 'a': 1, 'b': 128}, {'k': 'variant', 'a': 1, 'b': 128}, {'k': 'packQuantity', 'a': 1, 'b': 64}]"


@query(f"""
    SELECT target_identity, array_to_string(list_filter([
        CASE WHEN NOT coalesce(length(trim(target_name)) BETWEEN 1 AND 100, false) THEN 'name' END,
        CASE WHEN url IS NULL OR NOT regexp_matches(url, '^(?i)https://[^/?#@:]+(?::443)?(?:[/?][^#]*)?$') THEN 'url' END,
        CASE WHEN coalesce(len(change_types), 0) = 0 OR len(list_filter(change_types, lambda c: NOT list_contains({_KINDS}, c))) > 0 THEN 'changeTypes' END,
        CASE WHEN len(change_types) <> len(list_distinct(change_types)) THEN 'changeTypes repeat' END,
        CASE WHEN currency IS NOT NULL AND NOT regexp_full_match(trim(currency), '[A-Za-z]{{3}}') THEN 'currency' END,
        CASE WHEN len(ignore_text_patterns) > 10 OR len(list_distinct(ignore_text_patterns)) < len(ignore_text_patterns) OR
                  len(list_filter(ignore_text_patterns, lambda p: NOT length(trim(p)) BETWEEN 1 AND 128)) > 0 THEN 'ignoreTextPatterns' END,
        CASE WHEN len(list_filter(map_entries(product_identifiers), lambda e: len(list_filter({_IDS}, lambda i: i.k = e.key AND length(trim(e.value)) BETWEEN i.a AND i.b)) = 0)) > 0 THEN 'productIdentifiers' END
    ], lambda x: x IS NOT NULL), ';') AS problems FROM targets""")
def target_check(spark, d):
    """All targets, written as JSON and read as a target list is."""
    t = table(spark, d, "targets")
    made = F.struct(
        F.col("target_name").alias("name"), "url", F.col("change_types").alias("changeTypes"), F.col("ignore_text_patterns").alias("ignoreTextPatterns"),
        "currency", F.col("product_identifiers").alias("productIdentifiers"),
    )
    checked = config.check_targets(t.select("target_identity", F.to_json(made).alias("json")))
    short = F.transform("problems", lambda p: F.when(p.startswith("url:"), "url").otherwise(p))
    return checked.select("target_identity", F.array_join(short, ";").alias("problems"))


@query("""
    SELECT target_identity, arg_max(generation, (created_at, generation)) AS generation, arg_max(snapshot_hash, (created_at, generation)) AS snapshot_hash,
           epoch_us(min(created_at)) AS first_created_us FROM manifests WHERE manifest_kind = 'trusted' GROUP BY target_identity""")
def trusted_latest(spark, d):
    latest = history.latest_trusted(table(spark, d, "manifests"))
    return latest.select("target_identity", "generation", "snapshot_hash", F.unix_micros("first_created_at").alias("first_created_us"))


@query("""
    SELECT target_identity, generation, manifest_kind, candidate_id, CASE
        WHEN manifest_kind IS NULL OR manifest_kind NOT IN ('trusted', 'candidate') THEN 'kind'
        WHEN NOT coalesce(regexp_full_match(target_identity, '[0-9a-f]{64}'), false) THEN 'identity'
        WHEN NOT coalesce(regexp_full_match(snapshot_hash, '[0-9a-f]{64}'), false) OR NOT coalesce(regexp_full_match(generation, '[A-Za-z0-9_-]{1,64}'), false) THEN 'hash_or_generation'
        WHEN created_at IS NULL OR updated_at IS NULL THEN 'timestamps' WHEN byte_length IS NULL OR byte_length < 2 THEN 'byte_length'
        WHEN manifest_kind = 'candidate' AND (NOT coalesce(regexp_full_match(candidate_id, '[A-Za-z0-9_-]{1,128}'), false) OR
             (trusted_parent_snapshot_hash IS NOT NULL AND NOT regexp_full_match(trusted_parent_snapshot_hash, '[0-9a-f]{64}'))) THEN 'lineage' END AS problem
    FROM manifests""")
def manifest_check(spark, d):
    m = table(spark, d, "manifests")
    return m.select("target_identity", "generation", "manifest_kind", "candidate_id", history.manifest_problem(m).alias("problem"))


@query("""
    WITH t AS (SELECT target_identity, arg_max(snapshot_hash, (created_at, generation, snapshot_hash)) AS trusted FROM manifests WHERE manifest_kind = 'trusted' GROUP BY 1),
    c AS (SELECT target_identity, candidate_id, arg_max(snapshot_hash, (created_at, snapshot_hash)) AS h, arg_max(coalesce(trusted_parent_snapshot_hash, 'NO_PARENT'), (created_at, snapshot_hash)) AS p
          FROM manifests WHERE manifest_kind = 'candidate' GROUP BY 1, 2)
    SELECT target_identity, candidate_id, CASE WHEN nullif(p, 'NO_PARENT') IS DISTINCT FROM trusted THEN 'trusted' ELSE 'match' END AS promotion FROM c LEFT JOIN t USING (target_identity)""")
def promotion_check(spark, d):
    """Every candidate, asked for by its own hashes: only the latest trusted snapshot may disagree."""
    m = table(spark, d, "manifests")
    latest = F.max(F.struct("created_at", "snapshot_hash", F.coalesce("trusted_parent_snapshot_hash", F.lit("NO_PARENT")).alias("parent"))).alias("c")
    asked = m.filter("manifest_kind = 'candidate'").groupBy("target_identity", "candidate_id").agg(latest)
    requests = asked.select("target_identity", "candidate_id", F.col("c.snapshot_hash").alias("expected_hash"), F.col("c.parent").alias("expected_parent"))
    return history.promotable(m, requests).select("target_identity", "candidate_id", "promotion")


@query("""
    SELECT target_identity, entry_id, place FROM (
        SELECT target_identity, entry_id, row_number() OVER (PARTITION BY target_identity ORDER BY entry_id DESC) AS place
        FROM (SELECT DISTINCT target_identity, entry_id FROM evidence_history)) WHERE place <= 30""")
def history_last30(spark, d):
    return history.last_entries(table(spark, d, "evidence_history")).select("target_identity", "entry_id", "place")


@query("""
    WITH t AS (SELECT target_identity, arg_max(snapshot_hash, (created_at, generation)) AS trusted_hash FROM manifests
               WHERE manifest_kind = 'trusted' GROUP BY target_identity)
    SELECT DISTINCT m.target_identity, m.candidate_id,
           CASE WHEN trusted_hash IS NULL THEN 'no_trusted' WHEN trusted_parent_snapshot_hash IS NULL THEN 'no_parent'
                WHEN trusted_parent_snapshot_hash = trusted_hash THEN 'match' ELSE 'mismatch' END AS lineage
    FROM manifests m LEFT JOIN t USING (target_identity) WHERE manifest_kind = 'candidate'""")
def lineage_check(spark, d):
    return history.lineage(table(spark, d, "manifests")).select("target_identity", "candidate_id", "lineage").distinct()


@query("""
    SELECT user_id, event_id, epoch_ns(ts) // 1000 - lag(epoch_ns(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events""")
def origin_spacing(spark, d):
    return history.spacing(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("SELECT doc_id, true AS intact, octet_length(encode(text)) AS byte_length, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL")
def chunk_roundtrip(spark, d):
    parts = history.chunks(table(spark, d, "documents"), "doc_id", "text", 1024)
    return history.reassemble(parts, "doc_id").select("doc_id", "intact", "byte_length", F.sha2("text", 256).alias("text_hash"))


@query("""
    SELECT DISTINCT m.target_identity, m.snapshot_hash FROM manifests m WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT target_identity, arg_max(snapshot_hash, (created_at, generation)) AS h FROM manifests
                       WHERE manifest_kind = 'trusted' GROUP BY target_identity) t
        WHERE t.target_identity = m.target_identity AND t.h = m.snapshot_hash)""")
def obsolete_versions(spark, d):
    m = table(spark, d, "manifests")
    return history.obsolete(m, history.latest_trusted(m), ["target_identity", "snapshot_hash"])


@query("""
    SELECT user_id, CAST(date_trunc('week', timezone('UTC', ts)) AS DATE)::VARCHAR AS window_start, count(*) AS events,
           CAST(min(isodow(timezone('UTC', ts))) AS INT) AS first_day FROM events GROUP BY 1, 2""")
def weekly_window(spark, d):
    rows = weekly.windows(table(spark, d, "events"), "ts", "UTC")
    return rows.groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("events"), F.min("week_day").alias("first_day"))


@query("""
    SELECT user_id, CAST(date_trunc('week', timezone('America/New_York', timezone('UTC', ts))) AS DATE)::VARCHAR AS window_start, count(*) AS events,
           CAST(min(isodow(timezone('America/New_York', timezone('UTC', ts)))) AS INT) AS first_day FROM events GROUP BY 1, 2""")
def weekly_window_zone(spark, d):
    rows = weekly.windows(table(spark, d, "events"), "ts", "America/New_York")
    return rows.groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("events"), F.min("week_day").alias("first_day"))


def _by_destination(spark, d, mode: str | None = None):
    """Changes with their payload's destination, of one mode or of all."""
    p = table(spark, d, "webhook_payloads").filter(F.lit(True) if mode is None else F.col("delivery_mode") == mode)
    c = table(spark, d, "digest_changes").select(
        "payload_row", "change_id", reports.severity_rank(F.col("severity")).alias("rank"), F.col("confidence_score").alias("confidence"), F.col("change_row").alias("row_no")
    )
    return c.join(p.select("payload_row", F.col("destination_hash").alias("destination")), "payload_row").drop("payload_row")


_PEND = f"""SELECT p.destination_hash AS destination, c.change_id, {_RANK} AS rank, c.confidence_score AS confidence, c.change_row, p.delivery_mode
    FROM digest_changes c JOIN webhook_payloads p USING (payload_row) WHERE c.change_id IS NOT NULL"""
_PEND_ORDER = "rank DESC NULLS LAST, confidence DESC NULLS LAST, change_id"


@query(f"""
    WITH u AS (SELECT *, CASE WHEN delivery_mode = 'weekly_digest' THEN 0 ELSE 1 END AS side FROM ({_PEND}) WHERE delivery_mode IN ('weekly_digest', 'immediate')
               QUALIFY row_number() OVER (PARTITION BY destination, change_id ORDER BY side, change_row) = 1)
    SELECT destination, change_id, CAST(side AS INT) AS side, row_number() OVER (PARTITION BY destination ORDER BY {_PEND_ORDER}) AS place FROM u QUALIFY place <= 100""")
def pending_merge(spark, d):
    """What the weekly digests hold before what came at once: old before new, each change once."""
    old, new = _by_destination(spark, d, "weekly_digest"), _by_destination(spark, d, "immediate")
    return weekly.merged_pending(old, new).select("destination", "change_id", "side", "place")


@query(f"""
    WITH u AS (SELECT * FROM ({_PEND}) WHERE destination IS NOT NULL QUALIFY row_number() OVER (PARTITION BY destination, change_id ORDER BY change_row) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY {_PEND_ORDER}) AS place FROM u)
    SELECT destination, count(*) AS total, sha256('{{"destination":"' || destination || '","changes":' || CAST(to_json(list(change_id ORDER BY place) FILTER (WHERE place <= 10)) AS VARCHAR) || '}}') AS delivery_id
    FROM r GROUP BY destination""")
def immediate_deliveries(spark, d):
    return weekly.immediate(_by_destination(spark, d)).select("destination", "total", "delivery_id")


@query("""
    SELECT user_id AS destination, window_start, change_id, place FROM (
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(date_trunc('week', timezone('UTC', ts)) AS DATE)::VARCHAR AS window_start,
               CAST(event_id AS VARCHAR) AS change_id,
               row_number() OVER (PARTITION BY user_id, date_trunc('week', timezone('UTC', ts))
                                  ORDER BY length(event_type) DESC, CAST(floor(value) AS INT) DESC NULLS LAST, CAST(event_id AS VARCHAR)) AS place
        FROM events) WHERE place <= 100""")
def weekly_pending_top100(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("destination"),
        F.col("event_id").cast("string").alias("change_id"),
        F.length("event_type").alias("rank"),
        F.floor("value").cast("int").alias("confidence"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("row_no"),
    )
    return weekly.weekly_batch(e).select("destination", "window_start", "change_id", "place")


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, sha256({_sql_redact(_sql_collapse('text'), 2000)}) AS text_hash FROM documents")
def clean_text(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.sha2(text.clean(F.col("text")), 256).alias("text_hash"))


@query("SELECT doc_id, sha256(regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[REDACTED_EMAIL]', 'g')) AS text_hash FROM documents WHERE text IS NOT NULL")
def redact_email(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(text.redact_emails(F.col("text")), 256).alias("text_hash"))


@query("""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)),
        '(?i)\\b(bearer|basic)\\s+[a-z0-9._~+/=:-]+', '\\1 [REDACTED]', 'g'),
        '(?i)([?&](?:token|access_token|api[_-]?key|key|secret|signature|sig|password|session)=)[^&#\\s]+', '\\1[REDACTED]', 'g'),
        '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}(?:\\.[A-Za-z0-9_-]{8,})?\\b', '[REDACTED]', 'g'),
        '(?i)\\b(?:sk|pk|ghp|github_pat|xox[baprs])[-_A-Za-z0-9]{12,}\\b', '[REDACTED]', 'g'),
        '(?i)\\b(password|passwd|secret|api[-_]?key|access[-_]?token|token|session|signature|sig)\\s*[:=]\\s*[^\\s,;]+', '\\1=[REDACTED]', 'g')) AS text_hash
    FROM documents WHERE text IS NOT NULL""")
def redact_assignments(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(text.redact_secrets(F.col("text")), 256).alias("text_hash"))


@query(f"SELECT doc_id, {_sql_redact('text')} AS redacted FROM documents")
def redact_full(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.redact(F.col("text"), text.MAX_TEXT).alias("redacted"))


@query("""
    SELECT section_id, regexp_replace(text, '(?i)\\b(?:page\\s+rendered|generated|rendered)\\s+(?:at|on)\\s+[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.+-]+(?:Z|UTC)?\\b', '[render-time]', 'g') AS text
    FROM text_sections""")
def noise_masked(spark, d):
    return table(spark, d, "text_sections").select("section_id", text.mask_volatile(F.col("text")).alias("text"))


_IGNORED = _sql_collapse(_sql_globs(_sql_collapse("text"), "ignore_text_patterns"))


@query(f"""
    SELECT page_id, section_id, field, {_IGNORED} AS text FROM (
        SELECT page_id, NULL::BIGINT AS section_id, 'title' AS field, target_identity, title AS text FROM extracted_pages
        UNION ALL SELECT page_id, NULL, 'visible_text', target_identity, visible_text FROM extracted_pages
        UNION ALL SELECT s.page_id, s.section_id, 'section', p.target_identity, s.text FROM text_sections s LEFT JOIN extracted_pages p ON p.page_id = s.page_id)
    LEFT JOIN targets USING (target_identity)""")
def glob_ignore(spark, d):
    """Titles, whole texts and sections without what their target ignores."""
    wants = table(spark, d, "targets").select("target_identity", "ignore_text_patterns")
    pages = table(spark, d, "extracted_pages").select("page_id", "target_identity", "title", "visible_text")
    none = F.lit(None).cast("bigint").alias("section_id")
    sections = table(spark, d, "text_sections").select("page_id", "section_id", "text")
    rows = (
        pages.select("page_id", none, F.lit("title").alias("field"), "target_identity", F.col("title").alias("text"))
        .unionByName(pages.select("page_id", none, F.lit("visible_text").alias("field"), "target_identity", F.col("visible_text").alias("text")))
        .unionByName(
            sections.join(pages.select("page_id", "target_identity"), "page_id", "left").select(
                "page_id", "section_id", F.lit("section").alias("field"), "target_identity", "text"
            )
        )
    )
    rows = spread(rows.join(wants, "target_identity", "left"))
    kept = text.collapse(text.drop_globs(text.collapse(F.col("text")), F.col("ignore_text_patterns")))
    return rows.select("page_id", "section_id", "field", kept.alias("text"))


@query("""
    SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100), ''), 'unknown') AS slug,
           regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS model FROM part""")
def slug_and_model(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.model_id(F.col("p_brand")).alias("model"))


@query("""
    WITH v AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '$' || o_orderkey || '.5' WHEN 1 THEN '(1.' || o_orderkey || ',25)' WHEN 2 THEN '-' || o_orderkey || ',5'
                      WHEN 3 THEN 'EUR 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 4 THEN o_orderkey || ' per month' WHEN 5 THEN 'free' ELSE '0.125' END AS t FROM orders),
    k AS (SELECT *, regexp_replace(t, '[^0-9.,]', '', 'g') AS n FROM v)
    SELECT o_orderkey, CASE WHEN t LIKE '-%' OR t LIKE '(%)' THEN -1 ELSE 1 END * try_cast(
        CASE WHEN n LIKE '%,%' AND n LIKE '%.%' THEN replace(replace(n, '.', ''), ',', '.')
             WHEN n LIKE '%,%' OR n LIKE '%.%' THEN CASE WHEN length(string_split_regex(n, '[.,]')[-1]) BETWEEN 1 AND 2
                  THEN array_to_string(string_split_regex(n, '[.,]')[:-2], '') || '.' || string_split_regex(n, '[.,]')[-1] ELSE regexp_replace(n, '[.,]', '', 'g') END
             ELSE n END AS DOUBLE) AS value FROM k""")
def decimal_parse(spark, d):
    k = F.col("o_orderkey")
    s = k.cast("string")
    t = (
        F.when(k % 7 == 0, F.concat(F.lit("$"), s, F.lit(".5")))
        .when(k % 7 == 1, F.concat(F.lit("(1."), s, F.lit(",25)")))
        .when(k % 7 == 2, F.concat(F.lit("-"), s, F.lit(",5")))
        .when(k % 7 == 3, F.concat(F.lit("EUR 1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
        .when(k % 7 == 4, F.concat(s, F.lit(" per month")))
        .when(k % 7 == 5, F.lit("free"))
        .otherwise(F.lit("0.125"))
    )
    return table(spark, d, "orders").select("o_orderkey", numbers.decimal(t).alias("value"))


@query("""
    SELECT change_row, coalesce(upper(nullif(regexp_extract(current_excerpt, '(?i)\\b([A-Z]{3})\\b', 1), '')), CASE WHEN contains(current_excerpt, '€') THEN 'EUR'
           WHEN contains(current_excerpt, '£') THEN 'GBP' WHEN contains(current_excerpt, '₹') THEN 'INR' WHEN contains(current_excerpt, '¥') THEN 'JPY' END) AS currency
    FROM digest_changes""")
def currency_of(spark, d):
    return table(spark, d, "digest_changes").select("change_row", text.currency(F.col("current_excerpt")).alias("currency"))


@query("""
    SELECT section_id, CASE
        WHEN regexp_matches(t, '\\b(?:kilograms?|kgs?)\\b') THEN 'kg' WHEN regexp_matches(t, '\\b(?:grams?|gms?)\\b') THEN 'g'
        WHEN regexp_matches(t, '\\b(?:litres?|liters?|ltrs?)\\b') THEN 'l' WHEN regexp_matches(t, '\\b(?:millilitres?|milliliters?|mls?)\\b') THEN 'ml'
        WHEN regexp_matches(t, '\\b(?:metres?|meters?|mtrs?)\\b') THEN 'm' WHEN regexp_matches(t, '\\b(?:centimetres?|centimeters?|cms?)\\b') THEN 'cm'
        WHEN regexp_matches(t, '\\b(?:pieces?|pcs?)\\b') THEN 'piece' WHEN regexp_matches(t, '\\b(?:months?|mo)\\b') THEN 'month'
        WHEN regexp_matches(t, '\\b(?:years?|yr)\\b') THEN 'year' END AS unit,
        nullif(regexp_extract(text, '(?i)\\bv(?:ersion)?\\s*([0-9]+(?:\\.[0-9A-Za-z-]+)+)\\b', 1), '') AS version
    FROM (SELECT *, replace(lower(text), '.', '') AS t FROM text_sections)""")
def unit_and_version(spark, d):
    return table(spark, d, "text_sections").select(
        "section_id", text.unit(F.col("text")).alias("unit"), text.version(F.col("text")).alias("version")
    )


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(t, 'outofstock|out[ -]?of[ -]?stock|unavailable|sold[ -]?out') THEN 'out_of_stock'
        WHEN regexp_matches(t, 'instock|in[ -]?stock|available') THEN 'in_stock' WHEN regexp_matches(t, 'pre-?order') THEN 'preorder' ELSE 'other' END AS stock
    FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)""")
def availability_of(spark, d):
    found = text.availability(F.col("text"))
    known = F.when(found.isin("out_of_stock", "in_stock", "preorder"), found).otherwise("other")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", known.alias("stock"))


@query("""
    WITH x AS (SELECT section_id, nullif(regexp_extract(text, '(?i)(\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b|\\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+[0-9]{1,2},?\\s+[0-9]{4}\\b|\\b[0-9]{1,2}\\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+[0-9]{4}\\b)', 1), '') AS t FROM text_sections)
    SELECT section_id, CASE WHEN t IS NULL THEN NULL ELSE coalesce(
        CASE WHEN regexp_matches(t, '^[0-9]{4}-') THEN CAST(try_cast(t AS DATE) AS VARCHAR) END,
        CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN strftime(try_strptime(regexp_replace(replace(t, ',', ''), '\\s+', ' ', 'g'), '%B %d %Y'), '%Y-%m-%d') END,
        CASE WHEN regexp_matches(t, '^[0-9]{1,2}\\s') THEN strftime(try_strptime(regexp_replace(t, '\\s+', ' ', 'g'), '%d %B %Y'), '%Y-%m-%d') END, t) END AS found FROM x""")
def date_extract(spark, d):
    return table(spark, d, "text_sections").select("section_id", dates.extract(F.col("text")).alias("found"))


@query("""
    SELECT payload_row, generated_at IS NOT NULL AND regexp_matches(coalesce(generated_at, ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}Z$') AS exact,
           epoch_us(try_cast(generated_at AS TIMESTAMPTZ)) AS micros FROM webhook_payloads""")
def iso_instants(spark, d):
    return table(spark, d, "webhook_payloads").select(
        "payload_row",
        dates.is_iso_millis(F.col("generated_at")).alias("exact"),
        deliveries.delivery_instant("generated_at").alias("micros"),
    )


@query("SELECT change_row, regexp_replace(explanation, '([\\\\`*_{}\\[\\]()#+.!|>-])', '\\\\\\1', 'g') AS escaped FROM digest_changes")
def markdown_escape(spark, d):
    return table(spark, d, "digest_changes").select("change_row", text.escape_markdown(F.col("explanation")).alias("escaped"))


@query("SELECT payload_row, nullif(left(regexp_replace(delivery_id, '[^A-Za-z0-9_-]', '', 'g'), 64), '') AS id FROM webhook_payloads")
def clean_ids(spark, d):
    return table(spark, d, "webhook_payloads").select("payload_row", text.clean_id(F.col("delivery_id")).alias("id"))


# ---------------------------------------------------------------- URLs and addresses

_PARTS = "^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\\[[^\\]]*\\]|[^/:?#]*)(?::([0-9]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


@query(f"""
    SELECT page_id, lower(nullif(regexp_extract(url, '{_PARTS}', 1), '')) AS scheme, lower(nullif(regexp_extract(url, '{_PARTS}', 3), '')) AS url_host,
           nullif(regexp_extract(url, '{_PARTS}', 5), '') AS path, nullif(regexp_extract(url, '{_PARTS}', 6), '') AS query FROM extracted_pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "extracted_pages").select(
        "page_id",
        urls.part(u, "scheme").alias("scheme"),
        urls.part(u, "host").alias("url_host"),
        urls.part(u, "path").alias("path"),
        urls.part(u, "query").alias("query"),
    )


_VOLATILE = "(?i)^(?:utm_.+|gclid|fbclid|msclkid|cache(?:buster)?|cb|_|timestamp|ts|session(?:id)?)$"
_SENSITIVE = "(?i)authorization|cookie|token|secret|api[-_]?key|password|credential|session|signature|^sig$|^key$"
_HIDE = f"lambda p: CASE WHEN regexp_matches(split_part(p, '=', 1), '{_SENSITIVE}') THEN split_part(p, '=', 1) || '=%5BREDACTED%5D' ELSE p END"
_QUERY = "CASE WHEN len({0}) = 0 THEN '' ELSE '?' || array_to_string({0}, '&') END"


@query(f"""
    WITH u AS (
        SELECT 'page' AS kind, page_id AS row_no, url FROM extracted_pages UNION ALL SELECT 'change', change_row, target_url FROM digest_changes
        UNION ALL SELECT 'run', payload_row, run_url FROM webhook_payloads),
    q AS (SELECT *, lower(regexp_extract(url, '{_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{_PARTS}', 3)) || coalesce(nullif(regexp_extract(url, '{_PARTS}', 5), ''), '/') AS base,
                 list_filter(string_split(regexp_extract(url, '{_PARTS}', 6), '&'), lambda p: p <> '') AS pairs FROM u)
    SELECT kind, row_no, base || {_QUERY.format(f"list_transform(list_sort(list_filter(pairs, lambda p: NOT regexp_matches(split_part(p, '=', 1), '{_VOLATILE}'))), {_HIDE})")} AS canonical,
           base || {_QUERY.format(f"list_transform(pairs, {_HIDE})")} AS redacted, CASE WHEN base LIKE 'https://%' THEN base END AS run,
           regexp_extract(base, '^[a-z]+://[^/]+') AS origin FROM q""")
def url_canonical(spark, d):
    """Canonical, redacted and run URLs and origins of all URLs of pages, changes and runs."""
    pages = table(spark, d, "extracted_pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("row_no"), "url")
    changes = table(spark, d, "digest_changes").select(F.lit("change").alias("kind"), F.col("change_row").alias("row_no"), F.col("target_url").alias("url"))
    runs = table(spark, d, "webhook_payloads").select(F.lit("run").alias("kind"), F.col("payload_row").alias("row_no"), F.col("run_url").alias("url"))
    u = F.col("url")
    return pages.unionByName(changes).unionByName(runs).select(
        "kind",
        "row_no",
        urls.canonical(u).alias("canonical"),
        urls.redact_url(u).alias("redacted"),
        urls.run_url(u).alias("run"),
        urls.origin(u).alias("origin"),
    )


@query("""
    SELECT page_id, CASE WHEN url IS NULL OR url = '' OR length(url) > 2048 THEN 'length' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]') THEN 'unparseable'
           WHEN lower(url) NOT LIKE 'https://%' THEN 'scheme' WHEN regexp_matches(url, '://[^/?#]*@') THEN 'credentials' WHEN regexp_matches(url, '#.') THEN 'fragment'
           WHEN regexp_matches(url, '://[^/?#:]*:[0-9]+') AND NOT regexp_matches(url, '://[^/?#:]*:443(?:[/?#]|$)') THEN 'port'
           WHEN regexp_matches(url, '(?i)[?&](?:auth|authorization|cookie|token|access_token|secret|api[-_]?key|password|credential|session|signature|sig|key)(?:=|&|$)') THEN 'credential_key' END AS problem
    FROM extracted_pages""")
def url_policy(spark, d):
    return table(spark, d, "extracted_pages").select("page_id", urls.public_url_problem(F.col("url")).alias("problem"))


_NETS = " UNION ALL ".join(
    f"SELECT '{n}' AS network, {int(__import__('ipaddress').ip_network(n)[0])} AS low, {int(__import__('ipaddress').ip_network(n)[-1])} AS high" for n in net.BLOCKED_V4
)


@query(f"""
    WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS ip FROM orders), n AS ({_NETS})
    SELECT o_orderkey, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS address, n.network
    FROM a LEFT JOIN n ON ip BETWEEN low AND high""")
def ip_range_block(spark, d):
    ip = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    written = table(spark, d, "orders").select("o_orderkey", net.dotted(ip).alias("address"))
    return net.with_network(written.withColumn("ip", net.ipv4_number(F.col("address"))), "ip").select("o_orderkey", "address", "network")


_FORMS = """SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS ip FROM orders"""


@query(f"""
    WITH a AS ({_FORMS}), n AS ({_NETS}),
    w AS (SELECT o_orderkey, ip, unnest([CAST(ip AS VARCHAR), '0x' || printf('%x', ip), '0' || printf('%o', ip), (ip >> 24) || '.' || (ip & 16777215), (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || (ip & 65535)]) AS written FROM a)
    SELECT o_orderkey, written, 'v4' AS host_kind, n.network AS blocked_by FROM w LEFT JOIN n ON ip BETWEEN low AND high""")
def ip_forms(spark, d):
    """Every address of :func:`ip_range_block` in five other forms: the network found is the same."""
    ip = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    forms = F.array(
        ip.cast("string"),
        F.concat(F.lit("0x"), F.lower(F.hex(ip))),
        F.concat(F.lit("0"), F.conv(ip.cast("string"), 10, 8)),
        F.concat_ws(".", F.shiftright(ip, 24).cast("string"), ip.bitwiseAND(16777215).cast("string")),
        F.concat_ws(".", F.shiftright(ip, 24).cast("string"), F.shiftright(ip, 16).bitwiseAND(255).cast("string"), ip.bitwiseAND(65535).cast("string")),
    )
    written = table(spark, d, "orders").select("o_orderkey", F.explode(forms).alias("written"))
    return net.inspected(written, "written").select("o_orderkey", "written", "host_kind", "blocked_by")


@query("""
    SELECT host, count(*) AS pages, CASE WHEN host IS NOT NULL THEN 'name' END AS host_kind,
           CASE WHEN host = 'localhost' OR regexp_matches(host, '(?:\\.localhost|\\.local|\\.internal|\\.home|\\.lan|\\.arpa)$') THEN host END AS blocked_by
    FROM extracted_pages GROUP BY host""")
def host_suffix_block(spark, d):
    hosts = table(spark, d, "extracted_pages").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return net.inspected(hosts, "host").select("host", "pages", "host_kind", "blocked_by")


@query("""
    WITH a AS (SELECT host, 4 + CAST(page_id % 2 AS INT) * 2 AS family, '10.' || (page_id % 256) || '.0.1' AS address, page_id % 5 <> 0 AS public FROM extracted_pages)
    SELECT host, bool_and(public) AS all_public, min(family) AS family, arg_min(address, (family, address)) AS address FROM a GROUP BY host""")
def dns_all_public(spark, d):
    a = table(spark, d, "extracted_pages").select(
        "host",
        (F.lit(4) + (F.col("page_id") % 2).cast("int") * 2).alias("family"),
        F.concat(F.lit("10."), F.col("page_id") % 256, F.lit(".0.1")).alias("address"),
        (F.col("page_id") % 5 != 0).alias("public"),
    )
    pick = F.min(F.struct("family", "address"))
    return a.groupBy("host").agg(F.bool_and("public").alias("all_public"), pick.alias("p")).select("host", "all_public", "p.family", "p.address")


# ---------------------------------------------------------------- documents


_SCALAR = """CASE json_type({0}) WHEN 'VARCHAR' THEN {1} WHEN 'BOOLEAN' THEN {0}::VARCHAR WHEN 'NULL' THEN NULL
    ELSE regexp_replace(CAST(CAST({0}::VARCHAR AS DOUBLE) + 0.0 AS VARCHAR), '\\.0$', '') END"""


@query(f"""
    WITH j AS (SELECT 'fact' AS kind, fact_row AS row_no, CAST(fact_value AS JSON) AS v FROM facts WHERE json_valid(fact_value)
               UNION ALL SELECT 'event', event_id, CAST(props AS JSON) FROM events WHERE json_valid(props)),
    s AS (SELECT kind, row_no, '$' AS path, v FROM j WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT')
          UNION ALL SELECT kind, row_no, '$[' || (i - 1) || ']', v[i - 1] FROM (SELECT kind, row_no, v, unnest(range(1, json_array_length(v)::BIGINT + 1)) AS i FROM j WHERE json_type(v) = 'ARRAY')
          UNION ALL SELECT kind, row_no, '$.' || k, json_extract(v, '$.' || k) FROM (SELECT kind, row_no, v, unnest(json_keys(v)) AS k FROM j WHERE json_type(v) = 'OBJECT'))
    SELECT kind, row_no, path, {_SCALAR.format('v', _sql_redact("(v ->> '$')", 2000))} AS value FROM s""")
def json_flatten(spark, d):
    """Paths and scalars of all fact values and of the properties of events."""
    f = table(spark, d, "facts").select(F.lit("fact").alias("kind"), F.col("fact_row").alias("row_no"), F.col("fact_value").alias("body"))
    e = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("row_no"), F.col("props").alias("body"))
    return docs.with_paths(spread(f.unionByName(e)), "body").select("kind", "row_no", "path", "value")


@query()
def hidden_values(spark, d):
    """All fact values with secrets hidden by key and by form (tested against fixed cases)."""
    f = spread(table(spark, d, "facts").select("fact_row", "fact_value"))
    return f.select("fact_row", canon.hidden_column(F.col("fact_value")).alias("hidden"))


def _html(spark, d):
    """Pages as HTML, one paragraph per line, with the markup escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = spread(table(spark, d, "extracted_pages").select("page_id", "url", "title", "visible_text"))
    body = F.replace(esc(F.col("visible_text")), F.lit("\n"), F.lit("</p>\n<p>"))
    html = F.concat(
        F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><script>var x = '<p>';</script></head><body><p>"), body, F.lit("</p></body></html>")
    )
    return p.select("page_id", "url", html.alias("html"))


_TITLE, _BODY = (_sql_redact(_sql_collapse(f"coalesce({c}, '')"), n) for c, n in (("title", 500), ("visible_text", 50_000)))


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title, sha256({_BODY}) AS text_hash FROM extracted_pages")
def page_visible_text(spark, d):
    made = docs.with_html_document(_html(spark, d), "html", "url")
    return made.select("page_id", "document.title", F.sha2("document.visible_text", 256).alias("text_hash"))


@query("""
    SELECT content_type, CASE WHEN media IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN media = 'application/json' OR media LIKE '%+json' THEN 'json'
           WHEN media IN ('application/xml', 'text/xml') OR media LIKE '%+xml' THEN 'xml' WHEN media = 'text/plain' THEN 'text' END AS kind, count(*) AS n
    FROM (SELECT content_type, lower(trim(split_part(content_type, ';', 1))) AS media FROM extracted_pages) GROUP BY 1, 2""")
def content_kinds(spark, d):
    c = F.col("content_type")
    return table(spark, d, "extracted_pages").groupBy(c, docs.content_kind(c).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _documents(spark, d):
    """Pages as documents, beside what their target ignores; their policies and changelog are :func:`_sections`."""
    wants = table(spark, d, "targets").select("target_identity", "ignore_text_patterns", "currency")
    pages = table(spark, d, "extracted_pages").select(
        "page_id", F.col("target_identity").alias("of_target"), "title", "visible_text"
    )
    rows = spread(pages).join(wants.withColumnRenamed("target_identity", "of_target"), "of_target", "left")
    given = {"title": F.col("title"), "visible_text": F.col("visible_text")}
    fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.DOCUMENT.fields]
    return rows.select(
        # A page is a document of its own here, so its number takes the place of the target.
        F.col("page_id").cast("string").alias("target_identity"),
        "ignore_text_patterns",
        "currency",
        F.struct(*fields).alias("document"),
    )


def _sections(spark, d, documents):
    """All policies and changelog entries of documents, one row each with its place, however many a page has."""
    from pyspark.sql import Window

    rows = table(spark, d, "text_sections").select(
        F.col("page_id").cast("string").alias("target_identity"), "section_kind", "ord", "section_id", "heading", "text"
    )
    # Joined before they are numbered: both by the page, so a section is shuffled once.
    held = rows.join(documents.select("target_identity", F.col("ignore_text_patterns").alias("patterns_")), "target_identity")
    over = Window.partitionBy("target_identity", "section_kind").orderBy(F.asc_nulls_last("ord"), F.asc_nulls_last("section_id"))
    return held.withColumn("ord_", F.row_number().over(over) - 1)


_SLUG = (
    "coalesce(nullif(left(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100), ''), 'unknown')"
)


@query(f"""
    WITH p AS (SELECT CAST(p.page_id AS VARCHAR) AS page, p.page_id, p.visible_text, t.ignore_text_patterns AS globs FROM extracted_pages p LEFT JOIN targets t USING (target_identity)),
    s AS (SELECT p.page, p.globs, s.section_kind, s.heading, s.text, row_number() OVER (PARTITION BY s.page_id, s.section_kind ORDER BY s.ord, s.section_id) AS place
          FROM text_sections s JOIN p ON p.page_id = s.page_id),
    n AS (SELECT page, section_kind, place, {_SLUG.format("coalesce(heading, CASE section_kind WHEN 'policy' THEN 'section-' ELSE 'entry-' END || place)")} AS id,
                 {_sql_noise('text', 'globs')} AS body FROM s WHERE text IS NOT NULL),
    f AS (SELECT page, 0 AS producer, place, section_kind || ':' || id || ':text' AS fact_id, CAST(to_json(body) AS VARCHAR) AS fact_value FROM n WHERE body <> ''
          UNION ALL SELECT page, 1, 0, 'page:general-content', CAST(to_json(sha256(b)) AS VARCHAR) FROM (SELECT page, {_sql_noise('visible_text', 'globs')} AS b FROM p) WHERE b <> '')
    SELECT page AS target_identity, fact_id, arg_min(fact_value, place) AS fact_value FROM f GROUP BY page, fact_id""")
def document_texts(spark, d):
    """Facts of the texts of all pages and sections, without what their target ignores."""
    pages = _documents(spark, d)
    made = document_facts.document_facts(pages, F.col("currency"), F.col("ignore_text_patterns"), _sections(spark, d, pages))
    return made.filter("fact_id LIKE '%:text' OR fact_id = 'page:general-content'").select("target_identity", "fact_id", "fact_value")


@query(f"""
    SELECT CAST(page_id AS VARCHAR) AS page, sha256(b) AS content_hash FROM (
        SELECT p.page_id, {_sql_noise('visible_text', 't.ignore_text_patterns')} AS b FROM extracted_pages p LEFT JOIN targets t USING (target_identity)) WHERE b <> ''""")
def content_hash(spark, d):
    made = document_facts.text_facts(_documents(spark, d), F.col("ignore_text_patterns"))
    return made.select(F.col("target_identity").alias("page"), F.get_json_object(F.concat(F.lit('{"v":'), "fact_value", F.lit("}")), "$.v").alias("content_hash"))


@query("""
    SELECT page_id, i - 1 AS section_no, s.selector AS selector, length(s.text) AS n_chars
    FROM (SELECT page_id, unnest(selected_sections) AS s, generate_subscripts(selected_sections, 1) AS i FROM extracted_pages WHERE selected_sections IS NOT NULL)""")
def section_explode(spark, d):
    p = table(spark, d, "extracted_pages")
    return p.select("page_id", F.posexplode("selected_sections").alias("section_no", "s")).select(
        "page_id", "section_no", "s.selector", F.length("s.text").alias("n_chars")
    )


@query("""
    SELECT p.page_id, count(s.section_id) AS sections, count(s.text) AS with_text FROM extracted_pages p LEFT JOIN text_sections s ON s.page_id = p.page_id GROUP BY p.page_id""")
def page_sections(spark, d):
    # Sections are counted before the join, so a page with many of them loads no task.
    s = table(spark, d, "text_sections").groupBy("page_id").agg(F.count("section_id").alias("sections"), F.count("text").alias("with_text"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "extracted_pages").select("page_id").join(s, "page_id", "left").select("page_id", none("sections"), none("with_text"))


# ---------------------------------------------------------------- more of facts and reports


@query(f"""
    SELECT target_url, change_row, place FROM (
        SELECT target_url, change_row, row_number() OVER (PARTITION BY target_url ORDER BY {_ORDER}) AS place FROM digest_changes)
    WHERE place <= 100""")
def top100_per_target(spark, d):
    top = facts.top_per_group(table(spark, d, "digest_changes"), ["target_url"], reports.digest_order(), 100)
    return top.select("target_url", "change_row", "place")


@query("""
    SELECT change_row, nullif(regexp_extract(current_excerpt, '\\b([0-9][0-9,.]*)\\s+([A-Za-z][A-Za-z0-9 -]{1,40})\\b', 1), '') AS amount,
           coalesce(nullif(regexp_extract(current_excerpt, '(?i)\\b(?:pack\\s+of|qty|quantity)\\s*[:=]?\\s*([0-9]{1,5})\\b', 1), ''),
                    nullif(regexp_extract(current_excerpt, '(?i)\\b([0-9]{1,5})\\s*(?:pack|pk|pcs?|pieces?|units?)\\b', 1), '')) AS pack
    FROM digest_changes""")
def limits_mined(spark, d):
    from tidemark.operators.document_facts import LIMIT

    c = F.col("current_excerpt")
    return table(spark, d, "digest_changes").select(
        "change_row", F.nullif(F.regexp_extract(c, LIMIT, 1), F.lit("")).alias("amount"), text.pack_quantity(c).alias("pack")
    )


@query("""
    SELECT payload_row FROM webhook_payloads EXCEPT SELECT payload_row FROM (
        SELECT payload_row, nullif(lower(regexp_replace(delivery_id, '^\\s+|\\s+$', '', 'g')), '') AS ident, try_cast(generated_at AS TIMESTAMPTZ) AS instant
        FROM webhook_payloads) WHERE ident IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ident ORDER BY instant NULLS LAST, payload_row) > 1""")
def payloads_kept(spark, d):
    p = table(spark, d, "webhook_payloads")
    return deliveries.deduplicate(p, "delivery_id", deliveries.delivery_instant("generated_at"), "payload_row").select("payload_row")


@query("""
    SELECT target_identity, fact_id, generation, lag(fact_value) OVER (PARTITION BY target_identity, fact_id ORDER BY created_at, generation) AS previous, fact_value
    FROM (SELECT target_identity, fact_id, generation, fact_value FROM facts
          QUALIFY row_number() OVER (PARTITION BY target_identity, generation, fact_id ORDER BY ord, fact_row) = 1) f
    JOIN (SELECT target_identity, generation, min(created_at) AS created_at FROM manifests WHERE manifest_kind = 'trusted' GROUP BY 1, 2) m
    USING (target_identity, generation)""")
def fact_versions(spark, d):
    return _versions(spark, d, table(spark, d, "facts"))


def _versions(spark, d, chosen):
    """Each fact of the trusted snapshots beside its value in the version before."""
    from pyspark.sql import Window

    keys = ["target_identity", "generation", "fact_id"]
    one = facts.first_wins(chosen, keys, [F.col("ord"), F.col("fact_row")], ["fact_value"])
    at = (
        table(spark, d, "manifests")
        .filter("manifest_kind = 'trusted'")
        .groupBy("target_identity", "generation")
        .agg(F.min("created_at").alias("created_at"))
    )
    over = Window.partitionBy("target_identity", "fact_id").orderBy("created_at", "generation")
    return one.join(at, ["target_identity", "generation"]).select(
        *keys, F.lag("fact_value").over(over).alias("previous"), "fact_value"
    )


@query("""
    SELECT t.host, count(DISTINCT t.target_identity) AS targets, count(DISTINCT (m.target_identity, m.generation)) AS snapshots,
           CAST(coalesce(sum(m.byte_length), 0) AS BIGINT) AS bytes FROM targets t LEFT JOIN manifests m ON m.target_identity = t.target_identity GROUP BY t.host""")
def host_storage(spark, d):
    # Targets are unique, so snapshots and bytes are counted per target before the join.
    m = table(spark, d, "manifests").groupBy("target_identity").agg(
        F.countDistinct("generation").alias("snapshots"), F.sum("byte_length").alias("bytes")
    )
    joined = table(spark, d, "targets").select("host", "target_identity").join(m, "target_identity", "left")
    return joined.groupBy("host").agg(
        F.countDistinct("target_identity").alias("targets"),
        F.coalesce(F.sum("snapshots"), F.lit(0)).alias("snapshots"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


@query(_ENDS + """, n AS (
        SELECT p.target_identity, p.fact_id, c.category, c.field_path, try_cast(p.fact_value AS DOUBLE) AS a, try_cast(c.fact_value AS DOUBLE) AS b
        FROM p JOIN c ON p.target_identity = c.target_identity AND p.fact_id = c.fact_id WHERE p.fact_value IS DISTINCT FROM c.fact_value),
    k AS (SELECT *, floor((b - a) * 10000 + 0.5) / 10000 AS delta FROM n),
    l AS (SELECT *, CASE WHEN a <> 0 THEN floor(delta / a * 100 * 10000 + 0.5) / 10000 END AS pct,
                 upper(left(replace(category, '_', ' '), 1)) || substr(replace(category, '_', ' '), 2) AS label FROM k)
    SELECT target_identity, fact_id, label || CASE WHEN delta IS NULL THEN ' changed at ' ELSE CASE WHEN delta > 0 THEN ' increased' ELSE ' decreased' END || ' by ' ||
           regexp_replace(regexp_replace(format('{:.4f}', abs(delta)), '0+$', ''), '\\.$', '') ||
           CASE WHEN pct IS NULL THEN '' ELSE ' (' || regexp_replace(regexp_replace(format('{:.4f}', abs(pct)), '0+$', ''), '\\.$', '') || '%)' END || ' at ' END || field_path || '.' AS explanation
    FROM l""")
def change_explanations(spark, d):
    old, new = _two_versions(spark, d)
    keys = ["target_identity", "fact_id"]
    changed = facts.with_deltas(facts.compare(old, new, keys, "fact_value").filter("change_kind = 'changed'"))
    named = changed.join(new.select(*keys, "category", "field_path"), keys)
    said = facts.explanation(*[F.col(c) for c in ("category", "field_path", "change_kind", "delta", "delta_percent")])
    return named.select(*keys, said.alias("explanation"))


@query(f"""
    SELECT payload_row, count(*) AS total, sha256('{{"key":' || payload_row || ',"changes":' ||
           CAST(to_json(list(change_id ORDER BY place) FILTER (WHERE place <= 10)) AS VARCHAR) || '}}') AS delivery_hash
    FROM (SELECT *, row_number() OVER (PARTITION BY payload_row ORDER BY {_ORDER}) AS place FROM {_UNIQUE_IN}) GROUP BY payload_row""")
def payload_documents(spark, d):
    return reports.payload_documents(table(spark, d, "digest_changes"), "payload_row").select("payload_row", "total", "delivery_hash")


@query("""
    SELECT page_id, s.selector AS selector, s.text IS NOT NULL AS has_text
    FROM (SELECT page_id, unnest(CASE WHEN selected_sections IS NULL OR len(selected_sections) = 0 THEN [NULL] ELSE selected_sections END) AS s FROM extracted_pages)""")
def sections_outer(spark, d):
    p = table(spark, d, "extracted_pages").select("page_id", F.explode_outer("selected_sections").alias("s"))
    return p.select("page_id", "s.selector", F.col("s.text").isNotNull().alias("has_text"))


@query(f"SELECT fact_row, sha256({_CANONICAL}) AS hash, NULL::VARCHAR AS problem FROM facts WHERE fact_value IS NULL OR json_valid(fact_value)")
def canonical_values(spark, d):
    made = table(spark, d, "facts").select("fact_row", canon.canonical_column(F.col("fact_value")).alias("c"))
    return made.select("fact_row", "c.hash", "c.problem")
