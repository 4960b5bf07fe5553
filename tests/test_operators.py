"""Operators on small rows with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from convolake.functions import text as X
from convolake.functions.lexicon import Budgets
from convolake.operators import action_graph as G
from convolake.operators import dense as D
from convolake.operators import evaluation as E
from convolake.operators import evidence as V
from convolake.operators import relational as R
from convolake.operators import sessions as C
from convolake.operators import vectors as N
from convolake.plans import modeling as M

SCHEMA = "session_id string, utterance_id string, role string, content string, timestamp string"
TALK = [
    ("s1", "10", "Student", "I don't know [unclear]", "0:00:09"),
    ("s1", "1", "background", "Welcome", "0:00:00"),
    ("s1", "2", "tutor", "What is 2 + 2?", "0:00:02"),
    ("s1", "3", "student", "maybe four because two and two", "0:00:04"),
    ("s1", "4", "tutor", "Exactly, well done.", "0:00:06"),
    ("s1", "5", "tutor", "  Not quite; try again ", "soon"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(TALK, SCHEMA)


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.normalize(lit(" a  b\x85\n"))) == "a b"
    assert one(spark, X.tokens(lit("Straße’s DON’T 3x3"))) == ["strasse's", "don't", "3x3"]
    assert one(spark, X.word_count(lit("½ x² café a_b"))) == 4
    assert one(spark, X.clock_seconds(lit(" 1:02:03.5 "))) == 3723.5
    assert one(spark, X.clock_seconds(lit("1:62:03"))) is None
    assert one(spark, X.has_phrase(X.tokens(lit("Not, quite!")), ("not quite",)))
    assert not one(spark, X.has_phrase(X.tokens(lit("nota quite")), ("not quite",)))
    assert one(spark, X.is_question(lit("how many"), X.tokens(lit("how many")), ("how",)))
    assert one(spark, X.ratio(lit(1), lit(0))) == 0.0


def test_lines_are_in_numeric_order_whatever_the_input_order(spark, talk):
    got = [(r.ord, r.role, r.content) for r in C.ordered_lines(talk.orderBy(F.rand(1))).orderBy("ord").collect()]
    assert [g[0] for g in got] == list(range(6))
    assert got[0][1:] == ("background", "Welcome") and got[4][2] == "Not quite; try again" and got[5][1] == "student"


def test_session_view(talk):
    v = C.session_views(talk.withColumn("role", F.lower("role")).where("timestamp <> 'soon'")).first()
    assert (v.utterance_count, v.tutor_utterance_count, v.student_utterance_count, v.background_utterance_count) == (5, 2, 2, 1)
    assert v.duration_seconds == 9.0 and v.role_transition_count == 4 and v.role_transition_ratio == 1.0
    assert v.question_count == 1 and v.unclear_student_count == 1 and v.unclear_student_ratio == 0.5 and v.feedback_proxy_count == 1
    assert v.full_text.startswith("BACKGROUND: Welcome\nTUTOR: What is 2 + 2?\n") and v.closing_student_text.endswith("[unclear]")


@pytest.mark.parametrize(("toks", "obj", "want"), [(["a1", "c1", "a1", "a1"], ["a1", "a1", "b1"], 0.8 * 0.5 + 0.2 * 2 / 3), ([], ["a"], 0.0), (["a"], [], 0.0), (["x"], ["a"], 0.0)])
def test_overlap(spark, toks, obj, want):
    make = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.expr("cast(array() as array<string>)")
    assert one(spark, V.overlap(make(toks), make(obj))) == pytest.approx(want)


@pytest.mark.parametrize(("lengths", "budget", "want"), [((4, 6, 2, 1), 8, "aaaa\ncc"), ((9, 2), 5, "aaaaa"), ((0, 3), 3, "bbb"), ((3, 0), 0, "")])
def test_greedy_budget(spark, lengths, budget, want):
    items = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(i).alias("ord"), F.lit("abcd"[i] * n).alias("text")) for i, n in enumerate(lengths)])
    assert one(spark, V.joined(V.greedy(items, budget, 1))) == want


def test_join_chunks_drops_a_lone_break(spark):
    chunks = F.array(F.lit("abc"), F.lit(""), F.lit("def"))
    assert [one(spark, V.join_chunks(chunks, n)) for n in (3, 4, 5, 9)] == ["abc", "abc", "abc\nd", "abc\ndef"]


def test_windows_and_context(spark, talk):
    responses = spark.createDataFrame([("s1", 1, "two and two"), ("s1", 2, "the of")], "session_id string, objective_id int, objective string")
    s = V.scored(C.ordered_lines(talk), responses)
    qa = V.windows(s, 4, "qa").where("objective_id = 1").collect()
    assert [(r.start, r.stop) for r in qa] == [(1, 2)]
    fb = V.windows(s, 4, "feedback").where("objective_id = 1").collect()
    assert [(r.start, r.stop) for r in fb] == [(2, 3)]
    ctx = {r.objective_id: r.objective_context for r in V.context(s, Budgets()).collect()}
    assert ctx == {1: "tutor: What is 2 + 2?\nstudent: maybe four because two and two\ntutor: Exactly, well done.", 2: ""}
    d = {r.objective_id: r for r in D.dense_features(s, C.ordered_lines(talk)).collect()}
    assert len(d[1].asDict()) == 81 + 2
    assert d[1].objective_token_count == 2 and d[1].objective_coverage == 1.0 and d[2].relevant_line_count == 0
    assert d[1].qa_window_count == 1 and d[1].duration_seconds == 9.0 and d[1].unclear_line_count == 1
    assert all(math.isfinite(v) for k, v in d[2].asDict().items() if k not in ("session_id", "objective_id"))


def test_runs_thirds_and_edges(spark):
    d = spark.createDataFrame([("s", i, "student", [a]) for i, a in enumerate(["reasoning", "uncertainty"])] + [("t", i, "tutor", ["hint"]) for i in range(3)] + [("u", 0, "student", ["reasoning"])], "session_id string, at int, role string, actions array<string>")
    assert {r.session_id: r.reasoning_improvement_score for r in G.thirds(d).collect()} == {"s": -1.0, "t": 0.0, "u": 0.0}
    assert {r.session_id: r.n for r in G.longest_run(d, F.array_contains("actions", "hint"), "n").collect()} == {"s": 0, "t": 3, "u": 0}
    shape = {r.session_id: (r.node_count, r.edge_count, r.density) for r in G.graph_shape(d).collect()}
    assert shape == {"s": (2, 1, 0.5), "t": (1, 0, 0.0), "u": (1, 0, 0.0)}
    p = G.persistence(spark.createDataFrame([("s", 0, "tutor", ["correction"]), ("s", 1, "student", ["uncertainty"]), ("s", 2, "student", ["uncertainty"]), ("s", 3, "tutor", ["feedback"])], "session_id string, at int, role string, actions array<string>")).first()
    assert (p.misconception_persistence, p.unresolved_misconception_count) == (2, 0)


def test_metrics(spark):
    d = spark.createDataFrame([(0, 0.1), (1, 0.8), (1, 0.6), (0, 0.3)], "y int, p double")
    assert E.ece(d).first().ece == pytest.approx(0.25)
    assert E.roc_auc(d).first().auc == 1.0
    assert E.roc_auc(d.where("y = 1")).first().auc is None
    assert d.agg(E.brier(F.col("y"), F.col("p")).alias("b")).first().b == pytest.approx((0.01 + 0.04 + 0.16 + 0.09) / 4)
    assert one(spark, E.platt(F.lit(0.3), 1.0, 0.0)) == pytest.approx(0.3)
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError):
            E.platt(F.lit(0.3), bad, 0.0)
    with pytest.raises(ValueError):
        E.blend([(F.lit(0.1), 0.5), (F.lit(0.2), 0.6)])


def test_folds_purge_and_isolate(spark):
    rows = [(f"s{g}_{k}", f"o{g}", k % 2) for g in range(6) for k in range(6)] + [(f"x{g}", f"o{g}", 0) for g in range(6)] + [(f"x{g}", f"o{(g + 1) % 6}", 1) for g in range(6)]
    d = spark.createDataFrame(rows, "session string, grp string, y int")
    folds = E.snake_folds(d, "grp", "y", 3)
    seen = 0
    for k in range(3):
        s = E.splits(d, folds, "grp", "session", k)
        parts = {x: s.where(F.col("split") == x) for x in ("train", "validation", "purged")}
        assert parts["train"].join(parts["validation"], "session").count() == 0 and parts["train"].join(parts["validation"], "grp").count() == 0
        assert parts["purged"].count() > 0
        seen += parts["validation"].count()
    assert seen == len(rows)


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    c, o = N.l2_normalize(arr(3, 4)), N.l2_normalize(arr(0, 5))
    assert one(spark, N.interactions(c, o)) == pytest.approx([0.6, 0.8, 0, 1, 0.6, 0.2, 0, 0.8, 0.8])
    assert one(spark, N.l2_normalize(arr(0, 0))) is None
    scaled = N.scale(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "i int, a double, b double"), ["a", "b"]).orderBy("i").collect()
    assert [r.a for r in scaled] == pytest.approx([-(0.5**0.5), 0.5**0.5]) and {r.b for r in scaled} == {0.0}


def test_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in R.key_difference(a, b, "k").collect()} == {(1, "left"), (3, "right")}
    assert [tuple(r) for r in R.duplicate_keys(a, "k").collect()] == [(2, 2)]
    with pytest.raises(Exception, match="no v for 1"):
        R.map_dimension(a, b.withColumn("v", F.lit("x")), "k", "v").collect()
    ids = R.with_row_id(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").collect()
    assert all(r.row_id == r.k for r in ids) and len(ids) == 1000


def test_row_ids_of_more_rows_than_a_sample(spark):
    n = 300_007
    d = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 20).alias("v"))
    ids = R.with_row_id(d, "k")
    assert ids.agg(F.count("*"), F.count_if(F.col("row_id") == F.col("k"))).first() == (n, n)
    few = spark.createDataFrame([(5,), (None,), (-3,)], "k int")
    assert sorted((r.row_id, r.k) for r in R.with_row_id(few, "k").collect()) == [(0, -3), (1, 5), (2, None)]
    assert R.with_row_id(few.limit(0), "k").count() == 0


def test_heads_predict_row_by_row(spark):
    rows = [(str(i), [i / 50 - 1, (i * 7 % 50) / 25 - 1], int(i > 50), f"g{i % 5}", f"s{i % 9}") for i in range(100)]
    d = spark.createDataFrame(rows, "response_id string, x array<double>, y int, grp string, session string")
    model = M.fit_head(d, "x", "y")
    p = M.predict(d, [(model, "x", 1.0)])
    whole = {r.response_id: r.probability for r in p.collect()}
    part = {r.response_id: r.probability for r in M.predict(d.where("response_id < '3'").repartition(7), [(model, "x", 1.0)]).collect()}
    assert all(whole[k] == pytest.approx(v, abs=1e-9) for k, v in part.items())
    assert M.contract_faults(p, d.select("response_id")).first().asDict() == {"bad_values": 0, "repeated": 0, "missing": 0, "unknown": 0}
    a, b = M.fit_platt(d.withColumn("p", F.when(F.col("y") == 1, 0.7).otherwise(0.4)).union(d.withColumn("p", F.lit(0.5))), "p", "y")
    assert a > 0 and math.isfinite(b)


def test_ligatures_and_sharp_s_fold(spark):
    from pyspark.sql import functions as F

    from convolake.functions import text as X

    words = "ﬁrst oﬀer Straße STRAẞE ſo ﬃ K ŉ it’s"
    df = spark.createDataFrame([(words,)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["first", "offer", "strasse", "strasse", "so", "ffi", "k", "n", "it's"]
