"""Stores, audits, folds, calibration, vectors and inference, each against a plain version or the fault it has to find."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolake.functions.lexicon import Budgets
from convolake.operators import evaluation as E
from convolake.operators import evidence as V
from convolake.operators import relational as R
from convolake.operators import sessions as C
from convolake.operators import vectors as N
from convolake.plans import audits as A
from convolake.plans import inference as I
from convolake.plans import modeling as M
from convolake.sources import stores as S
from convolake.sources import tables as T

LINES = [
    ("a", "1", "background", "Fractions lesson", "0:00:00"),
    ("a", "2", "tutor", "What is one half plus one half?", "0:00:05"),
    ("a", "3", "student", "I think one because halves make a whole", "0:00:09"),
    ("a", "10", "tutor", "Exactly, great work", "0:00:15"),
    ("a", "11", "tutor", "Think about a quarter, what if you add it", "0:00:20"),
    ("a", "12", "student", "maybe not sure", "0:00:24"),
    ("b", "1", "student", "hello", "0:00:01"),
    ("c", "1", "student", "   ", None),
]
OBJECTIVES = [("a", 1, "add one half"), ("a", 2, "zebra"), ("b", 1, "add one half"), ("c", 2, "zebra"), ("d", 1, "add one half")]


@pytest.fixture(scope="module")
def transcripts(spark):
    return spark.createDataFrame(LINES, "session_id string, utterance_id string, role string, content string, timestamp string")


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(OBJECTIVES, "session_id string, objective_id long, objective string")


def test_every_response_has_all_its_features(transcripts, responses):
    d = I.response_views(transcripts, responses, Budgets())
    got = {(r.session_id, r.objective_id): r for r in d.collect()}
    assert set(got) == {o[:2] for o in OBJECTIVES}
    texts = [c for c, t in d.dtypes if t == "string" and c not in ("session_id", "objective")]
    numbers = [c for c, t in d.dtypes if t == "double"]
    graph = [c for c in numbers if c.startswith("graph_")]
    assert len(texts) == 10 and len(graph) == 14 and len(numbers) - len(graph) == 81
    match = got[("a", 1)]
    assert "one half plus one half" in match.objective_context and match.student_relevant.startswith("student: I think one")
    assert match.qa_window_count == 1 and match.feedback_window_count == 1 and match.feedback_text.endswith("Exactly, great work")
    other = got[("a", 2)]
    assert other.objective_context == other.tutor_relevant == other.student_relevant == "" and other.qa_text != ""
    assert other.utterance_count == 6 and other.duration_seconds == 24 and other.opening == match.opening
    assert match.graph_hint_count == 1 and match.graph_hint_depth == 1 and match.graph_tutor_intervention_count == 2
    assert other.graph_concept_transition_count == 0 < match.graph_concept_transition_count
    assert match.graph_unresolved_misconception_count == 1
    for key in (("c", 2), ("d", 1)):
        assert all(got[key][c] == "" for c in texts if key[0] == "d" or c not in ("full_text", "student_text"))
        assert all(got[key][c] == 0 for c in graph)
    assert all(got[("d", 1)][c] == 0 for c in numbers)


def test_lines_are_in_the_order_of_numbers_only_if_all_are(spark):
    rows = [("x", "10", "tutor", "c", None), ("x", "9", "tutor", "b", None), ("y", "10", "tutor", "a", None), ("y", "9", "tutor", "b", None), ("y", "z", "tutor", "c", None)]
    d = spark.createDataFrame(rows, "session_id string, utterance_id string, role string, content string, timestamp string")
    got = {r.session_id: r.tutor_text for r in C.session_views(d).collect()}
    assert got == {"x": "b\nc", "y": "a\nb\nc"}


def test_times_that_are_none_fail(spark):
    rows = [("x", "1", "tutor", "a", "2024-01-01T10:00:00"), ("x", "2", "tutor", "b", "2024-01-01 10:01:30")]
    schema = "session_id string, utterance_id string, role string, content string, timestamp string"
    assert C.session_views(spark.createDataFrame(rows, schema)).first().duration_seconds == 90
    with pytest.raises(Exception, match="no time"):
        C.session_views(spark.createDataFrame([("x", "1", "tutor", "a", "soon")], schema)).collect()


def test_joins_and_blocks_are_checked(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(ValueError, match="right"):
        R.one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="left"):
        R.one_to_one(b, a, "k")
    assert R.one_to_one(a, b.limit(1), "k", "left").count() == 2
    with pytest.raises(ValueError, match="blocks"):
        R.aligned(a, b.limit(1), key="k")
    assert R.aligned(a, a.withColumnRenamed("a", "c"), key="k").columns == ["k", "a", "c"]
    names = spark.createDataFrame([("ok.csv",), ("../x",), ("a/b",), ("a\\b",), ("..",), ("",), (None,)], "n string")
    assert R.unsafe_names(names, "n").count() == 6


def test_sources_are_found(spark, tmp_path):
    for name in ("train_features_1.csv", "train_labels_1.csv", "notes.txt"):
        (tmp_path / name).write_text("a\n")
    (tmp_path / "Train transcripts").mkdir()
    (tmp_path / "Train transcripts" / "s1.csv").write_text("a\n")
    found = S.discover_sources(spark, str(tmp_path))
    assert found["features"].endswith("train_features_1.csv") and found["archive"] is None
    assert S.discover_files(spark, str(tmp_path)) == (["notes.txt", "train_features_1.csv", "train_labels_1.csv"], {"Train transcripts": 1})
    (tmp_path / "train_labels_2.csv").write_text("a\n")
    with pytest.raises(ValueError, match="labels"):
        S.discover_sources(spark, str(tmp_path))
    (tmp_path / "train_labels_2.csv").unlink()
    (tmp_path / "Train transcripts" / "S1.csv").write_text("a\n")
    with pytest.raises(ValueError, match="case"):
        S.discover_sources(spark, str(tmp_path))


def test_stores_are_reused_while_they_hold(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(10).withColumn("x", F.col("id") * 2)

    path, args = str(tmp_path / "store"), {"version": "1", "sources": {"a": "h"}, "order": "id"}
    assert S.build_store(spark, path, make, **args) == "built"
    assert S.build_store(spark, path, make, **args) == "reused" and len(made) == 1
    assert S.manifest_of(spark, path)["rows"] == 10
    assert S.build_store(spark, path, make, **(args | {"sources": {"a": "other"}})) == "built"
    part = next(p for p in (tmp_path / "store").iterdir() if p.name.endswith(".parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "store" / f".{part.name}.crc").unlink(missing_ok=True)
    assert S.manifest_of(spark, path) is None
    assert S.build_store(spark, path, make, **args) == "built" and spark.read.parquet(path).count() == 10
    with pytest.raises(ValueError, match="columns"):
        S.build_store(spark, path, make, version="2", sources={}, schema=spark.range(1).schema)
    assert spark.read.parquet(path).count() == 10 and not [p for p in tmp_path.iterdir() if ".old-" in p.name]


def test_store_audits_find_faults(spark, tmp_path):
    ids = spark.range(3).withColumnRenamed("id", "row_id")
    good = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (2, 3, 2.0)], "row_id long, bucket long, value double")
    assert not any(S.sparse_faults(good, ids, 4).values())
    bad = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 4, float("nan")), (7, 0, 1.0)], "row_id long, bucket long, value double")
    assert S.sparse_faults(bad, ids, 4) == {"missing": 1, "unknown": 1, "repeated": 1, "out_of_range": 1, "not_finite": 1}
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="sparse store"):
        S.read_sparse(spark, str(tmp_path / "bad"), ids, 4)
    vectors = spark.createDataFrame([(0, [0.6, 0.8]), (1, [1.0, 1.0]), (1, [1.0]), (2, None)], "k int, v array<float>")
    assert S.vector_faults(vectors, "k", "v", 2) == {"width": 2, "not_finite": 0, "norm": 1, "repeated": 1}


def test_audits(spark):
    a = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, None, "")], "k int, x string, y string")
    d = {r.k: r.h for r in a.select("k", A.field_digest("x", "y").alias("h")).collect()}
    assert len(set(d.values())) == 3
    b = spark.createDataFrame([(1, "ab", "c"), (2, "a", "b"), (4, None, "")], "k int, x string, y string")
    assert A.parity(a, b, "k", ["x", "y"]).first().asDict() == {"only_left": 1, "only_right": 1, "different": 1, "same": 1}
    assert A.contiguous(spark.range(4), "id").first().contiguous and not A.contiguous(spark.range(1, 4), "id").first().contiguous
    report = {"components": {c: {"log_loss": v, "roc_auc": 0.6, "brier": 0.2, "ece10": 0.1} for c, v in (("baseline", 0.6), ("ensemble", 0.5))}, "folds": [1] * 5, "promotion_gate": {"passed": True}}
    assert A.evidence_faults(report, ("baseline", "ensemble"), 5) == []
    assert A.evidence_faults(report | {"promotion_gate": {"passed": False}}, ("baseline", "ensemble"), 5) == ["gate"]
    assert A.evidence_faults({}, ("baseline",), 5) == ["no baseline", "folds"]


def test_archives_are_the_same_each_time(spark, tmp_path):
    a = S.write_zip(str(tmp_path / "a.zip"), {"b.txt": b"1", "a/x.txt": b"2"})
    assert a == S.write_zip(str(tmp_path / "b.zip"), {"a/x.txt": b"2", "b.txt": b"1"})
    assert [r.name for r in T.zip_members(spark, str(tmp_path / "a.zip")).collect()] == ["a/x.txt", "b.txt"]
    with pytest.raises(ValueError, match="unsafe"):
        S.write_zip(str(tmp_path / "c.zip"), {"../x": b""})


def test_stratified_folds_are_even_and_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(rng.random() < 0.2 + 0.05 * (g % 9))) for g in range(40) for _ in range(int(rng.integers(5, 60)))]
    d = spark.createDataFrame(rows, "g int, y int")
    f = E.stratified_folds(d, "g", "y", 4).toPandas()
    assert len(f) == 40 and set(f["fold"]) == {0, 1, 2, 3}
    for c in ("size", "pos"):
        by = f.groupby("fold")[c].sum()
        assert by.max() - by.min() <= 0.2 * by.mean()
    again = E.stratified_folds(d.repartition(7), "g", "y", 4).toPandas()
    assert sorted(map(tuple, f.values)) == sorted(map(tuple, again.values))
    with pytest.raises(ValueError, match="more folds"):
        E.stratified_folds(d, "g", "y", 41)


def test_family_folds_need_a_family(spark):
    d = spark.createDataFrame([(g, s, g % 2) for g in range(6) for s in range(4)], "g int, s int, y int")
    families = spark.createDataFrame([(g, g // 2) for g in range(6)], "g int, family int")
    got = E.family_folds(d, families, "g", "y", 3)
    assert got.groupBy("family").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0 and got.count() == 24
    with pytest.raises(Exception, match="no family"):
        E.family_folds(d, families.where("g < 5"), "g", "y", 3).collect()


def test_nested_calibration_is_fitted_on_purged_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        z = float(rng.normal())
        rows.append((i, i % 12, int(i % 12 if rng.random() < 0.9 else 100 + i % 5), int(rng.random() < 1 / (1 + np.exp(-z))), float(1 / (1 + np.exp(-(2 * z + 0.5))))))
    d = spark.createDataFrame(rows, "i int, g int, s int, y int, p double")
    folds = E.snake_folds(d, "g", "y", 3)
    got = M.nested_platt(d, folds, "g", "s", "p", "y", 3).toPandas().set_index("i")
    assert len(got) == 3000
    where = {r.g: r.fold for r in folds.collect()}
    frame = d.toPandas()
    frame["fold"] = frame["g"].map(where)
    for k in range(3):
        held = frame[frame.fold == k]
        train = frame[(frame.fold != k) & ~frame.s.isin(set(held.s))]
        x, y, w = np.stack([np.log(train.p / (1 - train.p)), np.ones(len(train))], 1), train.y.to_numpy(), np.zeros(2)
        for _ in range(30):  # Newton
            q = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (y - q))
        want = 1 / (1 + np.exp(-(w[0] * np.log(held.p / (1 - held.p)) + w[1])))
        assert np.allclose(got.loc[held.i, "calibrated"], want, atol=2e-3)


def test_out_of_fold_heads_learn_and_the_semantic_scaler_leaves_its_prefix(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + 0.5 * x[:, 4] > 0).astype(int)
    d = spark.createDataFrame([(i, i % 6, i % 6 * 100 + i // 60, int(y[i]), [float(v) for v in x[i] * [1, 1, 1, 10, 10]]) for i in range(600)], "i int, g int, s int, y int, f array<double>")
    scaler = M.fit_semantic_scaler(d, "f", 3, 5)
    got = np.array([r[0] for r in d.orderBy("i").select(scaler.apply(F.col("f"))).collect()])
    assert np.allclose(got[:, :3], x[:, :3])
    tail = x[:, 3:] * 10
    assert np.allclose(got[:, 3:], (tail - tail.mean(0)) / tail.std(0) / np.sqrt(2))
    out = M.semantic_out_of_fold(d, "f", "y", "g", "s", 3, 5, c=10.0).toPandas()
    assert len(out) == 600 and np.mean((out.probability > 0.5) == (out.y == 1)) > 0.85
    with pytest.raises(ValueError, match="no training rows"):
        M.semantic_out_of_fold(d.withColumn("s", F.lit(1)), "f", "y", "g", "s", 3, 5)
    losses = spark.createDataFrame([("k25", 0.5, 0.6, 0.61), ("k50", 0.58, 0.59, 0.6)], "protocol string, e double, a double, b double")
    assert M.gate(losses, "e", ["a", "b"]).first().asDict() == {"passed": True, "worst_protocol": "k50", "worst_loss": 0.58}
    metrics = spark.createDataFrame([("k25", True, 0.5), ("k25", False, 0.52)], "protocol string, with_block boolean, ll double")
    assert M.ablation(metrics, "ll").first().delta == pytest.approx(-0.02)


def test_hashes_and_encoders(spark):
    d = spark.createDataFrame([(1, "Café É a b_c x"), (2, None)], "k int, t string")
    assert [r[0] for r in d.orderBy("k").select(N.words2(F.col("t"))).collect()] == [["cafe", "b_c"], []]
    calls = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, "blue")], "k int, t string")
    got = {r.k: r.vector for r in N.encode_once(calls, "k", "t", N.hashing_encoder(8), 8).collect()}
    assert len(got) == 2 and sum(v * v for v in got[1]) == pytest.approx(1)
    with pytest.raises(ValueError, match="several"):
        N.encode_once(calls.union(spark.createDataFrame([(2, "green")], "k int, t string")), "k", "t", N.hashing_encoder(8), 8)
    with pytest.raises(Exception, match="zero"):
        N.encode_once(calls, "k", "t", lambda ts: np.zeros((len(ts), 8)), 8).collect()
    with pytest.raises(ValueError, match="differ"):
        N.append_dense(spark.createDataFrame([(1, 0, 1.0)], "k int, bucket long, value double"), spark.createDataFrame([(2, 1.0)], "k int, x double"), ["k"], ["x"], 4)


def test_inference_of_a_folder(spark, tmp_path, transcripts, responses):
    train = I.dense_column(I.response_views(transcripts, responses)).withColumn("y", (F.col("objective_id") == 1).cast("int"))
    heads = tuple((M.fit_head(train, "dense", "y", reg=0.1), "dense", 0.5) for _ in range(2))
    folder = tmp_path / "test"
    (folder / "test_transcripts").mkdir(parents=True)
    for name in "abc":
        rows = [line for line in LINES if line[0] == name]
        text = "\n".join(",".join(f'"{v or "0:00:00"}"' for v in r) for r in rows)
        (folder / "test_transcripts" / f"{name}.csv").write_text("session_id,utterance_id,role,content,timestamp\n" + text + "\n")
    wanted = [("r3", "a", 1), ("r1", "b", 1), ("r2", "c", 2)]
    (folder / "test_features.csv").write_text("response_id,session_id,learning_objective_id,learning_objective\n" + "".join(f"{r},{s},{o},add one half\n" for r, s, o in wanted))
    (folder / "submission_format.csv").write_text("response_id,probability\n" + "".join(f"{r},0.5\n" for r, _, _ in wanted))
    got = [tuple(r) for r in I.predict_folder(spark, str(folder), I.Bundle(heads)).collect()]
    assert [g[0] for g in got] == ["r3", "r1", "r2"] and all(0 < g[1] < 1 for g in got)
    with pytest.raises(ValueError, match="slope"):
        I.predict_folder(spark, str(folder), I.Bundle(heads, (0.0, 0.0)))
    (folder / "submission_format.csv").write_text("response_id,probability\nr3,0.5\n")
    with pytest.raises(ValueError, match="differ"):
        I.predict_folder(spark, str(folder), I.Bundle(heads))
    bad = spark.createDataFrame([("r3", 1.5)], "response_id string, probability double")
    with pytest.raises(ValueError, match="contract"):
        I.in_order(bad, bad.select("response_id"))


def test_smoke_fixture(spark, transcripts):
    features = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "c")], "response_id string, session_id string")
    wanted = spark.createDataFrame([("r2",)], "response_id string")
    own, lines = S.smoke_fixture(wanted, features, transcripts)
    assert own.count() == 1 and {r.session_id for r in lines.collect()} == {"b"}
    with pytest.raises(ValueError, match="no features"):
        S.smoke_fixture(spark.createDataFrame([("r9",)], "response_id string"), features, transcripts)
    with pytest.raises(ValueError, match="repeated"):
        S.smoke_fixture(wanted.union(wanted), features, transcripts)


def test_reports_are_json(tmp_path):
    T.write_json(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]


def test_context_budgets_hold_for_all_responses(transcripts, responses):
    s = V.scored(C.ordered_lines(transcripts), responses)
    b = Budgets(context=20, role=15, window=30, edges=25)
    got = V.response_texts(s, C.session_views(transcripts), b).collect()
    assert len(got) == 4
    for r in got:
        assert len(r.objective_context) <= 20 and max(len(r.tutor_relevant), len(r.student_relevant)) <= 15 and max(len(r.qa_text), len(r.feedback_text)) <= 30 and max(len(r.opening), len(r.closing)) <= 25
