"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from convolake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "session_id"
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["session_views_texts", "budget_select_context", "graph_runs", "metric_auc", "dense_all"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(catalog.queries()[name](spark, DATA).toPandas()))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
