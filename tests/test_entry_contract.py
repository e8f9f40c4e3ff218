"""The driver contract: every registered query has an oracle with the same
column names."""

import duckdb

import __spark_entry__ as e
from conftest import SF
from runlens.sources.tables import TABLES


def test_every_query_has_an_oracle():
    """The library's own queries; those of the optional training-data part
    have one where SQL can express them."""
    from runlens.plans import catalog
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())



def test_oracle_columns_match_query_columns(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs = e.queries()
    for k, sql in e.oracle_sql().items():
        if k.startswith("stream_"):
            continue  # streams run to completion when built; covered by the oracle check
        cols = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall()]
        assert sorted(qs[k](spark, SF).columns) == sorted(cols), k
