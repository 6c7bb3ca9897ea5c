"""Messages that were delivered at least once: keep exactly one copy of each.

One hash aggregation by normalised identifier finds the copy to keep; map-side partial
aggregation collapses a hot identifier before anything is shuffled. The surplus copies are
found by an anti join on the *unique* row number, never on the identifier, so an identifier
that holds a third of all rows doesn't load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import unicode_trim

#: Larger than the microseconds of any timestamp that Spark can hold: null times come last.
_NEVER = "3000000000000000000"


def identifier(col: Column | str) -> Column:
    """Identifier without letter case and surrounding white space; null where it names nothing."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(unicode_trim(col)), F.lit(""))


def delivery_instant(col: Column | str) -> Column:
    """Microseconds since 1970 of ISO text with an offset; null if it is none."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(F.try_to_timestamp(F.trim(col)))


def delivery_order(instant: Column, row_no: Column) -> Column:
    """The pair (instant with nulls last, row number) packed into one decimal.

    ``min_by`` over a struct would need a sort-based aggregation, since a struct can't be
    updated in place in Tungsten's buffer; DECIMAL(38, 0) can, so this stays a hash aggregation.
    The order is that of the struct: instants have at most 18 digits, row numbers 19.
    """
    when = F.coalesce(instant.cast("decimal(19,0)"), F.lit(_NEVER).cast("decimal(19,0)"))
    shifted = when.cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (shifted + row_no).cast("decimal(38,0)")


def kept_copies(rows: DataFrame) -> DataFrame:
    """Of rows (ident, instant, row_no), the row number of the copy to keep per identifier.

    The copy with the earliest instant is kept, null instants last, then the smallest row
    number. Rows whose identifier is null identify nothing and are left out, as are rows whose
    number is null, which can't be named.
    """
    return (
        rows.filter(F.col("ident").isNotNull() & F.col("row_no").isNotNull())
        .groupBy("ident")
        .agg(F.min_by("row_no", delivery_order(F.col("instant"), F.col("row_no"))).alias("row_no"))
        .select("row_no")
    )


def surplus_copies(rows: DataFrame) -> DataFrame:
    """Row numbers of the copies to drop; rows as in :func:`kept_copies`, row_no unique.

    Null and blank identifiers are never surplus. An empty table gives no rows.
    """
    return (
        rows.filter(F.col("ident").isNotNull() & F.col("row_no").isNotNull())
        .select("row_no")
        .join(kept_copies(rows), "row_no", "left_anti")
    )


def deduplicate(df: DataFrame, id_col: str, instant: Column, row_no: str) -> DataFrame:
    """All columns of ``df`` without its surplus copies. Null or blank identifiers all stay."""
    rows = df.select(
        identifier(id_col).alias("ident"), instant.alias("instant"), F.col(row_no).alias("row_no")
    )
    gone = surplus_copies(rows).select(F.col("row_no").alias(row_no))
    return df.join(gone, row_no, "left_anti")


def payload_rows(payloads: DataFrame) -> DataFrame:
    """webhook_payloads as rows of :func:`kept_copies`."""
    return payloads.select(
        identifier("delivery_id").alias("ident"),
        delivery_instant("generated_at").alias("instant"),
        F.col("payload_row").alias("row_no"),
    )


def change_rows(changes: DataFrame, payloads: DataFrame) -> DataFrame:
    """digest_changes as rows of :func:`kept_copies`; the time is that of the payload row."""
    when = payloads.select("payload_row", delivery_instant("generated_at").alias("instant"))
    return (
        changes.select(
            "payload_row", identifier("change_id").alias("ident"), F.col("change_row").alias("row_no")
        )
        .filter(F.col("ident").isNotNull())
        .join(when, "payload_row", "left")
        .select("ident", "instant", "row_no")
    )


def surplus_deliveries(payloads: DataFrame, changes: DataFrame) -> DataFrame:
    """Surplus copies of both tables as (rec_kind, row_no)."""
    p = surplus_copies(payload_rows(payloads)).select(F.lit("payload").alias("rec_kind"), "row_no")
    c = surplus_copies(change_rows(changes, payloads)).select(F.lit("change").alias("rec_kind"), "row_no")
    return p.unionByName(c)
