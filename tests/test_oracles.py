"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA, needs_data
from orrery.plans import queries as _queries  # noqa: F401
from orrery.plans import registry


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in (DATA / "sf0.001").glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    registry.QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture()
def one_large_file(spark, tmp_path):
    """One filing whose 100 copies outrank the 30 passages of other filings."""
    hot = [(f"a{i:03}", "hot", "lithium lithium lithium prices of the same passage in every copy") for i in range(100)]
    rest = [(f"b{i:03}", f"f{i:03}", "lithium " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)]
    spark.createDataFrame([(*r, "2024-01-01") for r in hot + rest], "chunk_id string, source_file string, text string, ingested_at string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(100, "lithium", "user")], "id long, content string, role string").write.parquet(str(tmp_path / "messages.parquet"))
    return str(tmp_path)


def test_suppression_sees_past_the_copies_of_one_file(spark, one_large_file):
    got = [r.key for r in registry.QUERIES["near_dup_suppress"](spark, one_large_file).orderBy("rank").collect()]
    assert got == ["a000", *(f"b{i:03}" for i in range(30))]


def test_evidence_fills_its_rows_past_one_file(spark, one_large_file):
    got = registry.QUERIES["evidence_cut"](spark, one_large_file).orderBy("position").collect()
    assert [r.key for r in got] == ["a000", *(f"b{i:03}" for i in range(19))]


def test_names_are_looked_for_in_every_user_message(spark, tmp_path):
    rows = [(100, "Growth at Vantor", "user"), (101, "Profit of Vantr", " User "), (102, "Debt of Vantor", "human"), (103, "Vantor Motors", "assistant"), (104, None, "user")]
    spark.createDataFrame(rows, "id long, content string, role string").write.parquet(str(tmp_path / "messages.parquet"))
    spark.createDataFrame([("VNTR", "Vantor, Inc.", "f1")], "ticker string, company string, source_file string").write.parquet(str(tmp_path / "filings.parquet"))
    spark.createDataFrame([(2024,)], "fiscal_year int").write.parquet(str(tmp_path / "chunks.parquet"))
    run = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("capitalised_runs") == [(100, "Growth"), (100, "Vantor"), (101, "Profit of Vantr"), (102, "Debt of Vantor")]
    assert run("named_companies") == [(100, "VNTR", 1), (102, "VNTR", 1)]
    assert [r[1] for r in run("plan_with_near_misses")] == ["VNTR", "VNTR", "VNTR"] and [r[2] for r in run("plan")] == ["Growth", "Profit;Vantr", "Debt"]


def test_last_years_end_with_the_corpus(spark, tmp_path):
    spark.createDataFrame([(1, "sales since 2019"), (2, "the last three years"), (3, "in 2018, not the past two years, since 2020"), (4, "no year")], "id long, content string").write.parquet(str(tmp_path / "messages.parquet"))
    spark.createDataFrame([("a", 2022, "2024-01-01"), ("b", 2027, "2024-01-01")], "chunk_id string, fiscal_year int, ingested_at string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = sorted(map(tuple, registry.QUERIES["year_window_parse"](spark, str(tmp_path)).collect()))
    assert got == [(1, 2019, 2027), (2, 2025, 2027), (3, 2020, 2027)]
