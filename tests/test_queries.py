import duckdb
import pytest

from nodeloom.plans import catalogue, documents, imported

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "labels", "part", "pages", "events", "embeddings")


def rows(columns, data):
    return sorted(tuple(str(row[columns.index(c)]) for c in sorted(columns)) for row in data)


QUERIES, SQL = catalogue.queries() | documents.queries() | imported.queries(), catalogue.oracle_sql() | documents.oracle_sql() | imported.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        result = db.execute(SQL[name])
        expected = rows([c[0] for c in result.description], result.fetchall())
    df = QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_manifest_order_does_not_depend_on_the_writing_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(imported, "_made", {})
    turns = spark.range(36).selectExpr("10 * id as conv_id", "0 as turn", "'user' as role", "concat('text of ', id) as text")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks write the files, and name them
    try:
        found = QUERIES["export_manifest"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found.sort(key=lambda r: (r.episode_date, r.ep))
    assert [r.place for r in found] == list(range(36))
