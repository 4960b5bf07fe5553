"""Every session with every objective gives what the pairs of lines and objectives give."""

from functools import partial

import pytest

from convolake import catalog
from convolake.functions.lexicon import Budgets, Lexicon
from convolake.operators import dense as D
from convolake.operators import evidence as V
from convolake.operators import products as P
from convolake.operators import sessions as C

B = Budgets(context=60, role=50, window=70, edges=40, top_k=4, radius=2, edge_lines=3, max_gap=3)
QUERIES = ("anchor_topk", "budget_select_context", "budget_windows", "line_overlap_scores", "dense_match", "dense_all", "feedback_windows", "qa_windows")


@pytest.fixture(scope="module")
def talk(spark):
    """Sessions of 1 to 40 lines, empty and repeated ones among them, and objectives, some without a token or only of stop words."""
    words = "sum half area angle ratio the of proof ähre 7 it's".split()
    rows = []
    for s in range(9):
        for i in range((s * 7) % 41 + 1 if s != 4 else 40):
            n = (s * 31 + i * 17) % 23
            text = " ".join(words[(s + i * k + k * k) % len(words)] for k in range(n % 9)) + "?" * (n % 3 == 0)
            rows.append((s if s < 8 else None, str(i), ("student", "tutor", "background", "student")[(i * 5 + s) % 4], text if n % 9 else None, None))
    t = spark.createDataFrame(rows, "session_id long, utterance_id string, role string, content string, timestamp string")
    texts = ["half the area", "the of", "", None, "ratio ratio proof sum", "angle", "Ähre 7 it's proof", "zzz", "sum of the sum of the area"]
    o = spark.createDataFrame([(10 * i, x) for i, x in enumerate(texts)], "objective_id int, objective string")
    lines = C.ordered_lines(t, Lexicon(feedback=("half", "sum"), correction=("area", "7"))).cache()
    return lines, o, V.scored_all(lines.where("session_id is not null"), o).cache()


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names and dict(got.dtypes)["objective_id"] == "int"
    plain = lambda d: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.select(names).collect()), key=repr)
    found = plain(got)
    assert found == plain(want) and found


@pytest.mark.parametrize("cells", [7, 100, 1 << 19])
def test_products_are_the_pairs(monkeypatch, talk, cells):
    lines, o, s = talk
    monkeypatch.setattr(P, "over", partial(P.over, cells=cells))
    keys = list(V.RESPONSE)
    same(P.overlaps(lines, o), s.selectExpr(*keys, "cast(ord as long) ord", "ovl"))
    same(P.anchors(lines, o, 4), V.anchors(s, 4).selectExpr(*keys, "cast(ord as long) ord", "cast(rank as long) rank"))
    same(P.context(lines, o, B), V.context(s, B))
    for kind in ("qa", "feedback"):
        same(P.windows(lines, o, 3, kind), V.windows(s, 3, kind))
        same(P.window_texts(lines, o, B, kind), V.select_windows(V.windows(s, 3, kind), B.window, s))
    same(P.match_features(lines, o), D.match_features(s))
    same(P.dense_features(lines, o, B), D.dense_features(s, lines, B))


def test_no_rows_and_no_objectives(talk):
    lines, o, _ = talk
    assert not P.overlaps(lines.limit(0), o).count() and not P.context(lines, o.limit(0), B).count()


@pytest.mark.parametrize("name", QUERIES)
def test_no_query_makes_a_row_of_tokens_for_each_pair(spark, name):
    plan = catalog.queries()[f"{name}_x_benchmark"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
