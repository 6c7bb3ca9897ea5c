"""Address functions and the range join of addresses with blocked networks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Networks that are not public.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/32", "2001:2::/48", "2001:10::/28",
    "2001:20::/28", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8",
)
#: Names and endings of hosts that are not public.
BLOCKED_HOSTS = (
    "localhost", "localhost.localdomain", "instance-data", "metadata", "metadata.google.internal", "kubernetes.default.svc",
)
BLOCKED_ENDINGS = (".localhost", ".local", ".internal", ".home", ".lan", ".arpa")


def host_name(col: Column) -> Column:
    """Lower case, decoded, without a final dot and brackets; null if the escapes are broken."""
    low = F.regexp_replace(F.lower(F.trim(col)), r"\.$", "")
    once = F.when(F.instr(low, "%") > 0, F.lower(F.try_url_decode(low))).otherwise(low)
    twice = F.when(F.instr(once, "%") > 0, F.lower(F.try_url_decode(once))).otherwise(once)
    return F.regexp_replace(twice, r"^\[(.*)\]$", "$1")


def _number(part: Column) -> Column:
    """Number of a part of an address: hexadecimal, octal or decimal; null if none."""
    return (
        F.when(part.rlike("(?i)^0x[0-9a-f]{1,12}$"), F.conv(F.substring(part, 3, 12), 16, 10))
        .when(part.rlike("^0[0-7]{1,14}$"), F.conv(part, 8, 10))
        .when(part.rlike("^[0-9]{1,15}$"), part)
        .cast("bigint")
    )


def ipv4_number(col: Column) -> Column:
    """32-bit number of an IPv4 address of one to four parts, in any of their bases."""
    p = F.split(col, r"\.")
    n = [_number(F.get(p, F.lit(k))) for k in range(4)]
    whole = lambda x, most: x.isNotNull() & (x <= most)
    return (
        F.when((F.size(p) == 1) & whole(n[0], 4294967295), n[0])
        .when((F.size(p) == 2) & whole(n[0], 255) & whole(n[1], 16777215), n[0] * 16777216 + n[1])
        .when(
            (F.size(p) == 3) & whole(n[0], 255) & whole(n[1], 255) & whole(n[2], 65535),
            n[0] * 16777216 + n[1] * 65536 + n[2],
        )
        .when(
            (F.size(p) == 4) & whole(n[0], 255) & whole(n[1], 255) & whole(n[2], 255) & whole(n[3], 255),
            n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3],
        )
    )


def dotted(number: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def host_blocked(col: Column) -> Column:
    return col.isin(*BLOCKED_HOSTS) | col.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in BLOCKED_ENDINGS) + ")$")


def blocked_networks(spark: SparkSession) -> DataFrame:
    """The fixed IPv4 networks as (network, low, high)."""
    rows = [(n, int(ipaddress.ip_network(n)[0]), int(ipaddress.ip_network(n)[-1])) for n in BLOCKED_V4]
    return spark.createDataFrame(rows, "network string, low bigint, high bigint")


def with_network(df: DataFrame, number: str) -> DataFrame:
    """Rows with the blocked network that holds ``number``, null if none does.

    The fixed list has 15 rows, whatever the data, so it is broadcast.
    """
    nets = blocked_networks(df.sparkSession)
    return df.join(F.broadcast(nets), F.col(number).between(F.col("low"), F.col("high")), "left").drop("low", "high")


def ipv6_bytes(col: Column) -> Column:
    """The 16 bytes of an IPv6 address, zone left out; null for other text."""

    def one(text: str | None) -> bytes | None:
        try:
            return None if text is None else ipaddress.IPv6Address(text.partition("%")[0]).packed
        except ValueError:
            return None

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    shaped = col.contains(":")
    return F.when(shaped, F.pandas_udf(batch, T.BinaryType())(F.when(shaped, col)))


def with_network6(df: DataFrame, packed: str) -> DataFrame:
    """Rows with the smallest blocked network that holds the 16 bytes of ``packed``, null if none does.

    Of the fixed 15 networks none holds another, so a row has one at most; they are broadcast.
    """
    rows = [(n, bytearray(ipaddress.ip_network(n)[0].packed), bytearray(ipaddress.ip_network(n)[-1].packed)) for n in BLOCKED_V6]
    nets = df.sparkSession.createDataFrame(rows, "network6 string, low6 binary, high6 binary")
    return df.join(F.broadcast(nets), F.col(packed).between(F.col("low6"), F.col("high6")), "left").drop("low6", "high6")


def inspected(df: DataFrame, host: str) -> DataFrame:
    """Adds ``host_kind`` and ``blocked_by`` for a column of host names and addresses in any form.

    host_kind is 'name', 'v4' or 'v6', null for null and broken names; blocked_by is the name or
    the network that makes it no public host.
    """
    rows = df.withColumn("host_", host_name(F.col(host))).withColumn("v4_", ipv4_number(F.col("host_")))
    rows = with_network6(with_network(rows.withColumn("v6_", ipv6_bytes(F.col("host_"))), "v4_"), "v6_")
    kind = F.when(F.col("v4_").isNotNull(), "v4").when(F.col("v6_").isNotNull(), "v6").when(F.col("host_").isNotNull(), "name")
    by = F.coalesce("network", "network6", F.when(F.col("v4_").isNull() & F.col("v6_").isNull() & host_blocked(F.col("host_")), F.col("host_")))
    return rows.withColumn("host_kind", kind).withColumn("blocked_by", by).drop("host_", "v4_", "v6_", "network", "network6")
