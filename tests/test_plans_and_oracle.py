"""Plan shape assertions and the SQL oracle for every registered query."""

import duckdb
import pytest

import __spark_entry__ as E
from recipeflow.plans.registry import ORACLE, QUERIES
from conftest import SF_SMALL
from recipeflow.functions import parse as P
from recipeflow.functions import text as X
from recipeflow.sources.tables import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_operators_have_no_exchange(spark):
    d = load(spark, SF_SMALL, "documents", "doc_id", "text")
    q = d.select(
        "doc_id",
        X.normalize_query("text", "doc_id"),
        P.extract_titles("text"),
        P.parse_recipe("text"),
        X.post_edit("text", "doc_id"),
    )
    assert "Exchange" not in _plan(q)
    staged = P.with_recipe(d, "text")
    assert "Exchange" not in _plan(staged)


def test_scan_prunes_columns(spark):
    d = load(spark, SF_SMALL, "documents", "doc_id", "text").where("doc_id > 10")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "PushedFilters" in plan and "doc_id" in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.section for r in rows} == {"ingredients", "steps"}
    assert df.columns == ["section", "n_items", "n_recipes"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in sdf.collect())
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rel.fetchall())
    assert len(srows) == len(drows)
    assert srows == drows


def test_every_query_has_an_oracle():
    """Of the library's own queries; some of the optional training-data operators cannot be written in SQL."""
    assert set(QUERIES) == set(ORACLE) <= set(E.oracle_sql())
