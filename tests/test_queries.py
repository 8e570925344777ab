"""Every query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from chronoloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(values):
    def norm(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)

    return sorted(",".join(norm(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, got.select(*cols).collect())) == rows(want)


def test_every_order_recurs(spark):
    n = registry.load(spark, DATA, "orders").count()
    assert registry.queries()["t12_weekly_recurrence"](spark, DATA).count() == 6 * n


def test_every_member_has_a_rank(spark):
    got = registry.queries()["o4_role_order"](spark, DATA)
    assert got.count() == registry.load(spark, DATA, "customer").count() and got.agg({"rank_no": "max"}).first()[0] > 3


def test_every_team_has_its_collective_slots(spark):
    hosts = registry.load(spark, DATA, "events").selectExpr("user_id div 4 AS team").distinct().count()
    got = registry.queries()["t10_collective"](spark, DATA)
    assert got.select("team").distinct().count() == hosts
    assert got.where("team = 0").count() > 0


ODD = {
    "j22_first_of_a_type": ("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string", [(1, 1, 1_900_000, "R"), (1, 2, 5, "R"), (2, 3, 999_999, "R"), (2, 3, 1_000_000, "R"), (3, 1, None, "R"), (3, 2, 7, "R"), (4, 1, None, "R"), (5, 1, 1, "N")]),
    "m7_minutes_to_hour": ("customer", "c_custkey long, c_acctbal double", [(i, x + 60.0 * k) for i, (x, k) in enumerate((x, k) for x in (-0.5, 0.5, -0.49, -0.51, -1.5, 59.5, 59.49) for k in (-24, -2, -1, 0, 1, 24))] + [(99, None)]),
}


@pytest.mark.parametrize("name", ODD)
def test_query_on_odd_rows(spark, tmp_path, name):
    table, schema, values = ODD[name]
    spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, got.collect())) == rows(want)
