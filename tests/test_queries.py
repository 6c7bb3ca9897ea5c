"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    out = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(map(repr, out))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    made = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in made.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in made.fetchall()]
    assert plain(map(tuple, got.select(columns).collect())) == plain(rows)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_are_repeatable(spark, name):
    """Those without SQL give the same rows again, and at least one."""
    runs = [sorted(map(repr, entry.queries()[name](spark, str(DATA)).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]


def test_results_don_t_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(repr, entry.queries()["digest_top100"](spark, str(DATA)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_versions_of_all_categories(spark):
    facts = spark.read.parquet(str(DATA / "facts.parquet")).select("target_identity", "generation", "fact_id", "category")
    rows = entry.queries()["fact_versions"](spark, str(DATA)).join(facts, ["target_identity", "generation", "fact_id"])
    got = {r.category for r in rows.select("category").distinct().collect()}
    trusted = spark.read.parquet(str(DATA / "manifests.parquet")).filter("manifest_kind = 'trusted'")
    kept = facts.join(trusted, ["target_identity", "generation"]).select("category").distinct().collect()
    assert got == {r.category for r in kept} and len(got) > 1
