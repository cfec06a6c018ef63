"""Queries of the operators against their SQL, on whole tables."""

from collections import Counter

import duckdb
import pytest

from nodeloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "pages", "embeddings"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        result = db.execute(queries.oracle_sql()[name])
        columns, expected = [c[0] for c in result.description], Counter(result.fetchall())
    assert Counter(map(tuple, queries.queries()[name](spark, SF).select(*columns).collect())) == expected
