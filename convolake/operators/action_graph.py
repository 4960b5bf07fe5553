"""Action labels of lines and the graph of their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake.functions.lexicon import Lexicon
from convolake.functions.text import has_phrase, ratio, tokens, without

KEY = "session_id"
TUTOR_ACTIONS = ("hint", "question", "direct_explanation", "correction", "feedback")
STUDENT_ACTIONS = ("reasoning", "uncertainty", "confidence")


def labelled(lines: DataFrame, lex: Lexicon = Lexicon()) -> DataFrame:
    """Non-empty lines with their action labels and a position of their own."""
    toks = F.col("toks")
    tutor = [("hint", has_phrase(toks, lex.hint)), ("question", F.col("q")), ("direct_explanation", has_phrase(toks, lex.explanation)), ("correction", F.col("co")), ("feedback", F.col("fb"))]
    student = [("reasoning", has_phrase(toks, lex.action_reasoning)), ("uncertainty", has_phrase(toks, lex.action_uncertainty)), ("confidence", has_phrase(toks, lex.confidence))]
    pick = lambda role, labels: F.when(F.col("role") == role, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in labels])))
    found = F.coalesce(pick("tutor", tutor), pick("student", student), F.expr("cast(array() as array<string>)"))
    d = lines.where("ne").withColumn("actions", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other"))))
    return d.withColumn("at", F.row_number().over(Window.partitionBy(KEY).orderBy("ord")) - 1)


def _has(name: str) -> Column:
    return F.array_contains("actions", name)


def action_counts(d: DataFrame) -> DataFrame:
    """Hints, interventions (hints, questions or corrections) and distinct tutor actions."""
    tutor = F.array(*[F.lit(a) for a in TUTOR_ACTIONS])
    return d.groupBy(KEY).agg(
        F.count_if(_has("hint")).cast("long").alias("hint_count"),
        F.count_if(_has("hint") | _has("question") | _has("correction")).cast("long").alias("tutor_intervention_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("actions", tutor))))).cast("long").alias("strategy_diversity"),
    )


def longest_run(d: DataFrame, flag: Column, name: str, order: str = "at") -> DataFrame:
    """Length of the longest run of rows with a flag, per session (gaps and islands)."""
    w = Window.partitionBy(KEY).orderBy(order)
    runs = d.withColumn("_f", flag).withColumn("_island", F.sum((~F.col("_f")).cast("int")).over(w))
    runs = runs.groupBy(KEY, "_island").agg(F.count_if("_f").alias("_n"))
    return runs.groupBy(KEY).agg(F.max("_n").cast("long").alias(name))


def flips(d: DataFrame, flag: Column, name: str, order: str = "at") -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(order)
    return d.withColumn("_f", flag).withColumn("_g", F.lag("_f").over(w)).groupBy(KEY).agg(F.count_if(F.col("_f") != F.col("_g")).cast("long").alias(name))


def persistence(d: DataFrame, gap: int = 4) -> DataFrame:
    """Uncertain lines after a correction, and uncertain lines that nothing answers within the gap."""
    w = Window.partitionBy(KEY).orderBy("at")
    answered = F.max((_has("feedback") | _has("correction")).cast("int")).over(w.rowsBetween(1, gap))
    after = F.max(_has("correction").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_a", F.coalesce(answered, F.lit(0))).withColumn("_b", F.coalesce(after, F.lit(0)))
    return d.groupBy(KEY).agg(F.count_if(_has("uncertainty") & (F.col("_b") == 1)).cast("long").alias("misconception_persistence"), F.count_if(_has("uncertainty") & (F.col("_a") == 0)).cast("long").alias("unresolved_misconception_count"))


def thirds(d: DataFrame) -> DataFrame:
    """Late less early share of reasoning and of confidence among student lines; 0 below two lines."""
    s = d.where("role = 'student'").withColumn("_t", F.ntile(3).over(Window.partitionBy(KEY).orderBy("at")))

    def change(name: str) -> Column:
        share = lambda t: ratio(F.count_if(_has(name) & (F.col("_t") == t)), F.count_if(F.col("_t") == t))
        return F.when(F.count("*") < 2, 0.0).otherwise(share(3) - share(1))

    s = s.groupBy(KEY).agg(change("reasoning").alias("reasoning_improvement_score"), change("confidence").alias("confidence_change"))
    return d.select(KEY).distinct().join(s, KEY, "left").select(KEY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("reasoning_improvement_score", "confidence_change")])


def transitions(d: DataFrame) -> DataFrame:
    """Distinct ordered pairs of unequal labels on neighbouring lines."""
    w = Window.partitionBy(KEY).orderBy("at")
    e = d.select(KEY, F.lag("actions").over(w).alias("_p"), "actions").where("_p is not null")
    e = e.select(KEY, F.explode("_p").alias("src"), "actions").select(KEY, "src", F.explode("actions").alias("dst"))
    return e.where("src <> dst").distinct()


def graph_shape(d: DataFrame) -> DataFrame:
    nodes = d.select(KEY, F.explode("actions").alias("a")).groupBy(KEY).agg(F.countDistinct("a").alias("node_count"))
    out = transitions(d).groupBy(KEY, "src").agg(F.count("*").alias("deg"))
    out = out.groupBy(KEY).agg(F.sum("deg").alias("edge_count"), F.max("deg").alias("max_node_degree"))
    g = nodes.join(out, KEY, "left").na.fill(0)
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return g.select(KEY, F.col("node_count").cast("long").alias("node_count"), F.col("edge_count").cast("long").alias("edge_count"), ratio(F.col("edge_count"), pairs).alias("density"), ratio(F.col("edge_count"), F.col("node_count")).alias("mean_node_degree"), F.col("max_node_degree").cast("double").alias("max_node_degree"))


#: The features of a session that don't depend on the objective, and the one that does.
FEATURES = (
    "hint_count", "hint_depth", "strategy_diversity", "correction_chain_length", "tutor_intervention_count", "concept_transition_count", "reasoning_improvement_score",
    "confidence_change", "misconception_persistence", "unresolved_misconception_count", "density", "mean_node_degree", "max_node_degree", "node_count",
)


def session_graph(d: DataFrame) -> DataFrame:
    """The thirteen features of every session with a line."""
    parts = [action_counts(d), longest_run(d, _has("hint") | _has("question"), "hint_depth"), longest_run(d, _has("correction"), "correction_chain_length"), persistence(d), thirds(d), graph_shape(d)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, KEY)
    return out


def concept_transitions(lines: DataFrame, responses: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    """Per response, how often neighbouring lines differ in whether they hold a token of the objective; without stop words, none if nothing else is left."""
    keys = [KEY, "objective_id"]
    d = lines.where("ne").select(KEY, "ord", "toks").join(responses.withColumn("_obj", without(tokens(F.col("objective")), stopwords)), KEY)
    w = Window.partitionBy(*keys).orderBy("ord")
    d = d.withColumn("_f", F.arrays_overlap("toks", "_obj")).withColumn("_g", F.lag("_f").over(w))
    return d.groupBy(*keys).agg(F.count_if(F.col("_f") != F.col("_g")).cast("long").alias("concept_transition_count"))


def response_graph(lines: DataFrame, actions: DataFrame, responses: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    """The fourteen features of every response; zeros for a session without a line that is not empty."""
    keys = [KEY, "objective_id"]
    d = responses.select(*keys).join(session_graph(actions), KEY, "left").join(concept_transitions(lines, responses, stopwords), keys, "left")
    return d.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"graph_{c}") for c in FEATURES])
