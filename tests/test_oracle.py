"""Every query with a SQL twin gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracklight.plans import all_queries, q_graph, q_outcomes, q_signals, q_wallets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = all_queries.queries(), all_queries.oracle_sql()


def canon(df):
    df = df[sorted(df.columns)]
    show = lambda v: "None" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, row)) for row in df.itertuples(index=False)), sorted(df.columns)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Steps that many queries begin with are written once for all of these tests."""
    known = {}

    def once(name, make):
        def found(spark, sf_dir, *_):
            if name not in known:
                known[name] = make(spark, sf_dir)
            return known[name]

        return found

    patch = pytest.MonkeyPatch()
    for module, name in ((q_outcomes, "k_outcomes"), (q_outcomes, "k_assets"), (q_outcomes, "tracked"), (q_signals, "tracked"), (q_graph, "k_edges"), (q_wallets, "k_metrics"), (q_wallets, "k_scores")):
        patch.setattr(module, name, once(name, getattr(module, name)))
    yield
    patch.undo()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE[name]).df()
    assert canon(got)[1] == canon(want)[1]
    assert canon(got)[0] == canon(want)[0]


def test_queries_without_sql_have_tests_of_their_own():
    """They are held against plain Python in test_jobs.py."""
    assert set(QUERIES) - set(ORACLE) == {"nightly_decisions"}
