"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def registered():
    import __spark_entry__ as entry
    from workload.registry import QUERIES as own

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(own) <= set(queries)
    return {n: queries[n] for n in own}, {n: oracles[n] for n in own if n in oracles}


QUERIES, ORACLES = registered()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(row[i]) for i in at) for row in result.fetchall())


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    """No query pairs every row with every row, and scans read only what is used."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name in ("check_pk", "check_fk", "double_applied", "evolve_recreate"):
        assert "l_shipdate" not in plan and "props" not in plan and "o_orderpriority" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["check_fk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan
    assert "Not(EqualTo(o_orderstatus,P))" in plan


@pytest.mark.parametrize("name", [
    "catalog_fks", "schema_diff", "schema_report", "contract_counts", "sqlite_schema_diff", "sqlite_catalog", "sqlite_type_map",
    "trigger_header", "catalog_pks", "contract_rows", "pg_type_map", "catalog_columns", "catalog_enums",
])
def test_listings_are_never_broadcast(spark, name, monkeypatch):
    """Catalogue rows come out of arrays, so Spark's estimate of their size is far too low."""
    monkeypatch.setattr("workload.registry.DEALT", 10)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert "RoundRobinPartitioning" in plan


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    """A table may be one file or a folder of files."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["stream_drift"](spark, str(tmp_path))
    assert got.exceptAll(QUERIES["stream_drift"](spark, SF)).count() == 0 and got.count() > 0


@pytest.mark.parametrize("name", ["trigger_header", "catalog_pks", "pg_type_map", "contract_rows"])
def test_tasks_read_few_shuffled_bytes(spark, name):
    """Catalogue rows are many times larger in memory than in a shuffle."""
    own = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(own)
    QUERIES[name](spark, SF)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(spark.conf.get(own))
    spark.conf.unset(own)
    assert size <= 16
