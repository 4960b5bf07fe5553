"""Session lines and session views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake.functions import lexicon as L
from convolake.functions import text as X

ROLES = ("tutor", "student", "background")


def transcript(conversations: DataFrame) -> DataFrame:
    """Chat rows as a transcript: session_id, utterance_id, role, content, timestamp."""
    role = F.when(F.col("role") == "user", "student").when(F.col("role") == "assistant", "tutor").when(F.col("role") == "system", "background").otherwise("other")
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("string").alias("utterance_id"), role.alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("timestamp"))


def ordered_lines(t: DataFrame, lex: L.Lexicon = L.Lexicon()) -> DataFrame:
    """Normalised lines in total order with their tokens, flags and position; one shuffle by session."""
    content = X.normalize(F.col("content"))
    number = F.col("utterance_id").try_cast("double")
    ts = X.clock_seconds(F.col("timestamp"))
    d = t.select("session_id", "utterance_id", F.coalesce(F.lower(F.trim("role")), F.lit("other")).alias("role"), content.alias("content"), number.alias("_number"), ts.alias("ts"))
    order = Window.partitionBy("session_id").orderBy(F.col("_number").isNull(), "_number", "utterance_id", F.coalesce("ts", F.lit(float("inf"))), "role", "content")
    d = d.withColumn("ord", F.row_number().over(order) - 1).drop("_number")
    d = d.withColumn("toks", X.tokens(F.col("content")))
    toks = F.col("toks")
    return d.select(
        "session_id", "ord", "role", "content", "ts", "toks",
        (F.col("content") != "").alias("ne"),
        F.when(F.col("content") != "", F.concat_ws(": ", "role", "content")).otherwise("").alias("rendered"),
        X.is_question(F.col("content"), toks, lex.starters).alias("q"),
        X.has_phrase(toks, lex.feedback).alias("fb"),
        X.has_phrase(toks, lex.correction).alias("co"),
        X.has_phrase(toks, lex.reasoning).alias("re"),
        X.has_phrase(toks, lex.uncertainty).alias("un"),
    )


def raw_lines(t: DataFrame) -> DataFrame:
    """Lines of raw content in utterance order, for the views: by number if all ids of the session are numbers, else by text."""
    session = Window.partitionBy("session_id")
    number = F.col("utterance_id").try_cast("double")
    d = t.withColumn("_number", number).withColumn("_text_ids", F.max(F.isnull("_number")).over(session))
    order = session.orderBy(F.when(~F.col("_text_ids"), F.col("_number")), "utterance_id")
    return d.withColumn("ord", F.row_number().over(order) - 1).drop("_number", "_text_ids")


def seconds(timestamp: Column) -> Column:
    """Seconds of a clock time, or of an ISO date and time; a value that is neither fails the query, null stays null."""
    iso = F.unix_micros(F.try_to_timestamp(timestamp)) / 1_000_000
    found = F.coalesce(X.clock_seconds(timestamp), iso)
    return F.when(timestamp.isNotNull() & (F.trim(timestamp) != "") & found.isNull(), F.raise_error(F.concat(F.lit("no time: "), timestamp)).cast("double")).otherwise(found)


def _in_order(value: Column, when: Column | None = None) -> Column:
    item = F.struct("ord", value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(item if when is None else F.when(when, item))), lambda s: s["v"])


def session_views(t: DataFrame) -> DataFrame:
    """One row per session: texts, counts, ratios and proxies, in one shuffle by session."""
    d = raw_lines(t)
    w = Window.partitionBy("session_id").orderBy("ord")
    text, role = F.col("content"), F.col("role")
    d = d.withColumn("_words", X.word_count(text)).withColumn("_chars", F.length(text)).withColumn("_turned", (F.lag("role").over(w) != role).cast("int")).withColumn("_ts", seconds(F.col("timestamp")))
    line = F.concat(F.upper(role), F.lit(": "), text)
    student, tutor = role == "student", role == "tutor"
    n = lambda cond: F.count_if(cond).cast("long")
    aggs = [
        F.array_join(_in_order(line), "\n").alias("full_text"),
        *[F.array_join(_in_order(text, role == r), "\n").alias(f"{r}_text") for r in ROLES],
        F.array_join(F.slice(_in_order(line), 1, 8), "\n").alias("opening_text"),
        *[F.array_join(_last(_in_order(text, role == r), 3), "\n").alias(f"closing_{r}_text") for r in ("tutor", "student")],
        F.count("*").cast("long").alias("utterance_count"),
        F.sum("_chars").cast("long").alias("char_count"),
        F.sum("_words").cast("long").alias("word_count"),
        *[n(role == r).alias(f"{r}_utterance_count") for r in ROLES],
        *[F.sum(F.when(role == r, F.col("_chars")).otherwise(0)).cast("long").alias(f"{r}_char_count") for r in ROLES],
        *[F.sum(F.when(role == r, F.col("_words")).otherwise(0)).cast("long").alias(f"{r}_word_count") for r in ROLES],
        F.coalesce(F.max("_ts") - F.min("_ts"), F.lit(0.0)).alias("duration_seconds"),
        n(student & X.matches_between(text, L.UNCLEAR_PATTERN)).alias("unclear_student_count"),
        n(F.contains(text, F.lit("?"))).alias("question_count"),
        F.coalesce(F.sum("_turned"), F.lit(0)).cast("long").alias("role_transition_count"),
        n(student & (F.col("_words") <= 5)).alias("short_student_count"),
        n(tutor & X.matches_between(text, L.FEEDBACK_PATTERN)).alias("feedback_proxy_count"),
        n(tutor & X.matches_between(text, L.CORRECTION_PATTERN)).alias("correction_proxy_count"),
    ]
    v = d.groupBy("session_id").agg(*aggs)
    for r in ROLES:
        for kind in ("utterance", "char", "word"):
            v = v.withColumn(f"{r}_{kind}_ratio", X.ratio(F.col(f"{r}_{kind}_count"), F.col(f"{kind}_count")))
    rates = {"unclear_student": "student_utterance_count", "question": "utterance_count", "short_student": "student_utterance_count", "feedback_proxy": "tutor_utterance_count", "correction_proxy": "tutor_utterance_count"}
    for name, over in rates.items():
        v = v.withColumn(f"{name}_ratio", X.ratio(F.col(f"{name}_count"), F.col(over)))
    return v.withColumn("role_transition_ratio", X.ratio(F.col("role_transition_count"), F.col("utterance_count") - 1))


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))
