"""Every query with an oracle against DuckDB on a small scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import quern.plans.facts  # noqa: F401  adds its queries
import quern.plans.folding  # noqa: F401  adds its queries
import quern.plans.intake  # noqa: F401  adds its queries
import quern.plans.listings  # noqa: F401  adds its queries
import quern.plans.pages  # noqa: F401  adds its queries
import quern.plans.searches  # noqa: F401  adds its queries
import quern.plans.streams  # noqa: F401  adds its queries
from quern.operators import entity, geo
from quern.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return repr(int(v) if v == int(v) else float(v))
    if type(v).__name__ in ("Timestamp", "datetime", "date"):
        return str(pd.Timestamp(v))
    return str(v)


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_supplier_is_point_and_place(spark):
    rows = QUERIES["haversine_within_radius_all"](spark, "/root/testdata/sf0.01").collect()
    found, keys = {(r.id, r.place) for r in rows}, {r.s_suppkey for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()}
    assert len(found) == len(rows) and found == {(b, a) for a, b in found} and all(a != b for a, b in found)
    assert len({a for a, _ in found if a % 5}) > len(keys) / 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def against_sql(spark, name, folder):
    """The rows of a query over the tables of a folder, after comparing them with its SQL."""
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    got = table(QUERIES[name](spark, str(folder)).toPandas())
    assert got == table(c.execute(ORACLE[name]).df())
    return got[1]


def test_pairs_of_equal_sets_and_of_none(spark, tmp_path):
    rows = [(k, ("red bolt", "bolt red", "red gear bolt", "", "!", "old nut")[k % 6], ("A", "B", None)[k % 5 % 3]) for k in range(200)] + [(5, "red bolt", "A"), (6, "nut", "B")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    assert len(against_sql(spark, "jaccard_pairs_blocked", tmp_path)) > 1000


@pytest.mark.parametrize("chunk", [1, 7, 512])
def test_pairs_in_chunks_come_once(spark, chunk):
    words = ["a b c", "a b d", "a b c d", "x y", "a", "c d e f g", "c d e f"]
    rows = [(k, "AB"[k % 2], sorted(words[k * k % 7].split(), reverse=k % 3 == 0)) for k in range(90)]
    got = [tuple(r) for r in entity.similar_pairs(spark.createDataFrame(rows, "k long, b string, w array<string>"), "k", "b", "w", chunk=chunk, task=100).collect()]
    want = [(a, b) for a, x, v in rows for b, y, w in rows if a < b and x == y and len({*v} & {*w}) * 2 >= len({*v} | {*w})]
    assert sorted(got) == want


@pytest.mark.parametrize("name", ["nearest_per_type", "nearest_per_type_all", "haversine_within_radius_all", "location_score_decay_all", "location_score_decay", "haversine_within_radius"])
def test_equal_positions_are_looked_at_once(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame([(1000 * k + k % 5, None if k % 7 == 3 else k * k % 25) for k in range(600)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, None if k % 11 == 3 else k % 25) for k in range(400)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    real, looked = geo.within, []

    def within(*a, **k):
        looked.append(real(*a, **k).count())
        return real(*a, **k)

    monkeypatch.setattr(geo, "within", within)
    assert len(against_sql(spark, name, tmp_path)) >= 600
    assert 0 < sum(looked) < 5000
