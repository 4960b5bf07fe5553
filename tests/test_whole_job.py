"""Queries over all of their rows, where the smallest tables don't show what is left out."""

import duckdb
import pytest

from convolake import catalog

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def many_items(tmp_path_factory):
    """Twenty conversations and two hundred objectives."""
    d = tmp_path_factory.mktemp("items")
    for name, sf in (("conversations", "sf0.001"), ("benchmark", "sf0.1")):
        (d / f"{name}.parquet").symlink_to(f"{DATA}/{sf}/{name}.parquet")
    return str(d)


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["line_overlap_scores_x_benchmark", "anchor_topk_x_benchmark", "budget_select_context_x_benchmark"])
def test_every_objective_is_scored(spark, many_items, name):
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{many_items}/{t}.parquet')")
    got = catalog.queries()[name](spark, many_items).toPandas()
    assert rows(got) == rows(con.execute(catalog.oracle_sql()[name]).df())
    assert got.objective_id.max() >= 40
    if name.startswith("line"):
        assert len(got) == 87 * 200 and len(got.drop_duplicates(["session_id", "objective_id"])) == 20 * 200


def test_dense_features_of_every_objective(spark, many_items):
    got = catalog.queries()["dense_all_x_benchmark"](spark, many_items).select("session_id", "objective_id").toPandas()
    assert len(got) == len(got.drop_duplicates()) == 20 * 200


def test_texts_that_begin_alike_stay_apart(spark, tmp_path):
    texts = [("user", "the same start, one end"), ("user", "the same start, another"), ("system", "the same start, one end"), ("user", "the same start, one end"), ("user", None)]
    spark.createDataFrame([(i, 0, r, t) for i, (r, t) in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in catalog.queries()["distinct_role_texts"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(set(texts), key=str)
