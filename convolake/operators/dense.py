"""Dense features of a response's lines, by conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake.functions.text import finite, ratio
from convolake.operators.evidence import RESPONSE, context, windows
from convolake.functions.lexicon import Budgets

SEGMENTS = ("early", "mid", "late")
SEGMENT_METRICS = ("student_share", "student_mean_chars", "student_reasoning_ratio", "student_uncertainty_ratio", "tutor_question_ratio", "tutor_feedback_ratio", "tutor_correction_ratio")


def _n(cond: Column) -> Column:
    return F.count_if(cond).cast("double")


def match_features(s: DataFrame) -> DataFrame:
    """How a session's lines meet the objective."""
    last = Window.partitionBy(*RESPONSE)
    hit = F.col("ovl") > 0
    d = s.withColumn("_n1", F.max("ord").over(last)).withColumn("_place", F.when(hit, ratio(F.col("ord"), F.col("_n1"))))
    d = d.groupBy(*RESPONSE).agg(
        F.first(F.size("obj")).cast("double").alias("objective_token_count"),
        F.first(F.size(F.array_distinct("obj"))).cast("double").alias("objective_unique_token_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("obj", "toks"))))).cast("double").alias("matched_objective_unique_count"),
        _n(hit).alias("relevant_line_count"),
        _n(F.col("ne")).alias("_ne"),
        F.coalesce(F.max("ovl"), F.lit(0.0)).alias("max_line_overlap"),
        F.coalesce(F.avg(F.when(hit, F.col("ovl"))), F.lit(0.0)).alias("mean_positive_line_overlap"),
        *[F.coalesce(f("_place"), F.lit(0.0)).alias(f"{name}_match_position") for name, f in (("first", F.min), ("last", F.max), ("mean", F.avg))],
    )
    d = d.withColumn("objective_coverage", ratio(F.col("matched_objective_unique_count"), F.col("objective_unique_token_count"))).withColumn("relevant_line_ratio", ratio(F.col("relevant_line_count"), F.col("_ne")))
    return d.drop("_ne")


def volume_features(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Counts, shares, lengths and times over all lines."""
    w = Window.partitionBy(*keys).orderBy("ord")
    role = F.col("role")
    d = lines.withColumn("_len", F.length("content")).withColumn("_turn", F.coalesce((F.lag("role").over(w) != role).cast("int"), F.lit(0))).withColumn("_unclear", F.regexp_count("content", F.lit(r"(?i)\[\s*unclear\s*\]")))
    d = d.groupBy(*keys).agg(
        F.count("*").cast("double").alias("utterance_count"),
        _n(F.col("ne")).alias("nonempty_utterance_count"),
        *[_n(role == r).alias(f"{r}_count") for r in ("tutor", "student", "background")],
        _n(~role.isin("tutor", "student", "background")).alias("other_role_count"),
        F.sum("_turn").cast("double").alias("role_transition_count"),
        F.sum("_unclear").cast("double").alias("unclear_occurrence_count"),
        _n(F.col("_unclear") > 0).alias("unclear_line_count"),
        F.sum("_len").cast("double").alias("total_char_count"),
        F.sum(F.size("toks")).cast("double").alias("total_token_count"),
        F.avg("_len").alias("mean_line_chars"),
        F.percentile("_len", F.lit(0.5)).alias("median_line_chars"),
        F.max("_len").cast("double").alias("max_line_chars"),
        F.greatest(F.coalesce(F.max("ts") - F.min("ts"), F.lit(0.0)), F.lit(0.0)).alias("duration_seconds"),
        *[F.sum(F.when(role == r, F.col("_len")).otherwise(0)).cast("double").alias(f"_{r}_chars") for r in ("tutor", "student")],
        *[_n((role == r) & F.col("q")).alias(f"{r}_question_count") for r in ("tutor", "student")],
        _n((role == "tutor") & F.col("fb")).alias("tutor_feedback_count"),
        _n((role == "tutor") & F.col("co")).alias("tutor_correction_count"),
    )
    shares = {f"{r}_ratio": (f"{r}_count", "utterance_count") for r in ("tutor", "student", "background")} | {"other_role_ratio": ("other_role_count", "utterance_count"), "unclear_line_ratio": ("unclear_line_count", "nonempty_utterance_count"), "tutor_char_ratio": ("_tutor_chars", "total_char_count"), "student_char_ratio": ("_student_chars", "total_char_count"), "tutor_question_ratio": ("tutor_question_count", "tutor_count"), "student_question_ratio": ("student_question_count", "student_count"), "tutor_feedback_ratio": ("tutor_feedback_count", "tutor_count"), "tutor_correction_ratio": ("tutor_correction_count", "tutor_count")}
    for name, (a, b) in shares.items():
        d = d.withColumn(name, ratio(F.col(a), F.col(b)))
    d = d.withColumn("role_transition_ratio", ratio(F.col("role_transition_count"), F.col("utterance_count") - 1)).withColumn("utterances_per_minute", ratio(60 * F.col("nonempty_utterance_count"), F.col("duration_seconds")))
    return d.drop("_tutor_chars", "_student_chars")


def segment_features(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Seven metrics of each third of the lines, and their differences from the first third."""
    d = lines.withColumn("_t", F.ntile(3).over(Window.partitionBy(*keys).orderBy("ord")))
    aggs = []
    for i, name in enumerate(SEGMENTS, 1):
        own, st, tu = F.col("_t") == i, (F.col("_t") == i) & (F.col("role") == "student"), (F.col("_t") == i) & (F.col("role") == "tutor")
        values = [ratio(_n(st), _n(own)), F.coalesce(F.avg(F.when(st, F.length("content"))), F.lit(0.0)), ratio(_n(st & F.col("re")), _n(st)), ratio(_n(st & F.col("un")), _n(st)), ratio(_n(tu & F.col("q")), _n(tu)), ratio(_n(tu & F.col("fb")), _n(tu)), ratio(_n(tu & F.col("co")), _n(tu))]
        aggs += [v.alias(f"{name}_{m}") for m, v in zip(SEGMENT_METRICS, values, strict=True)]
    d = d.groupBy(*keys).agg(*aggs)
    for m in SEGMENT_METRICS:
        for name in ("mid", "late"):
            d = d.withColumn(f"{m}_{name}_minus_early", F.col(f"{name}_{m}") - F.col(f"early_{m}"))
    return d


def session_features(lines: DataFrame, b: Budgets = Budgets()) -> DataFrame:
    """The features that don't depend on the objective, windows counted too; a row for each session."""
    own = lines.withColumn("objective_id", F.lit(0)).withColumn("ovl", F.lit(0.0))
    session = volume_features(lines).join(segment_features(lines), "session_id")
    for kind, name in (("qa", "qa_window_count"), ("feedback", "feedback_window_count")):
        session = session.join(windows(own, b.max_gap, kind).groupBy("session_id").agg(F.count("*").cast("double").alias(name)), "session_id", "left")
    return session


def dense_features(s: DataFrame, lines: DataFrame, b: Budgets = Budgets()) -> DataFrame:
    """All 81 features of each response: 13 of its match with the objective, 2 counts of windows, and 66 of its session, made once a session.

    Windows are counted over the lines of a session too, as they don't depend on the objective.
    """
    keys = list(RESPONSE)
    ctx = context(s, b).select(*keys, ratio(F.length("objective_context"), F.lit(b.context)).alias("selected_context_char_ratio"))
    d = match_features(s).join(ctx, keys).join(session_features(lines, b), "session_id")
    return d.select(*keys, *[finite(F.col(c)).alias(c) for c in d.columns if c not in keys])
