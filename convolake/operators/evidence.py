"""Objective-conditioned evidence: overlap, anchors, neighbours, budgets and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake.functions import text as X
from convolake.functions.lexicon import STOPWORDS, Budgets

RESPONSE = ("session_id", "objective_id")


def objective_tokens(text: Column) -> Column:
    """Tokens without stop words, or all tokens where nothing else is left."""
    return X.let(X.tokens(text), lambda t: X.let(X.without(t, STOPWORDS), lambda s: F.when(F.size(s) > 0, s).otherwise(t)))


def conditioned(lines: DataFrame, responses: DataFrame) -> DataFrame:
    """Lines of each response's session beside the objective's tokens; responses: session_id, objective_id, objective."""
    return lines.join(responses.withColumn("obj", objective_tokens(F.col("objective"))), "session_id")


def overlap(toks: Column, obj: Column) -> Column:
    """0.8 of the share of distinct objective tokens met, 0.2 of the share of their occurrences."""

    def score(unique: Column) -> Column:
        count = lambda a, t: F.size(a) - F.size(F.array_remove(a, t))
        met = F.aggregate(unique, F.lit(0), lambda acc, t: acc + F.least(count(toks, t), count(obj, t)))
        return F.lit(0.8) * F.size(F.array_intersect(unique, toks)) / F.size(unique) + F.lit(0.2) * met / F.size(obj)

    return F.when((F.size(toks) == 0) | (F.size(obj) == 0), F.lit(0.0)).otherwise(X.let(F.array_distinct(obj), score))


def scored(lines: DataFrame, responses: DataFrame) -> DataFrame:
    return conditioned(lines, responses).withColumn("ovl", overlap(F.col("toks"), F.col("obj")))


def scored_all(lines: DataFrame, objectives: DataFrame) -> DataFrame:
    """Lines of every session scored for every objective; objectives: objective_id, objective."""
    return lines.crossJoin(objectives.withColumn("obj", objective_tokens(F.col("objective")))).withColumn("ovl", overlap(F.col("toks"), F.col("obj")))


def anchors(s: DataFrame, k: int, by_role: bool = False) -> DataFrame:
    """The k best lines of positive overlap of each response (and role), ties to the earlier line."""
    keys = [*RESPONSE, "role"] if by_role else list(RESPONSE)
    w = Window.partitionBy(*keys).orderBy(F.col("ovl").desc(), "ord")
    return s.where("ovl > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(s: DataFrame, k: int, radius: int) -> DataFrame:
    """Line positions in priority order: each anchor, then its neighbours outwards, previous before next."""
    n = s.groupBy(*RESPONSE).agg(F.count("*").alias("n"))
    offsets = [(0, 0)] + [x for d in range(1, radius + 1) for x in ((-d, 2 * d - 1), (d, 2 * d))]
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in offsets])
    e = anchors(s, k).select(*RESPONSE, "rank", "ord", F.explode(steps).alias("step"))
    e = e.select(*RESPONSE, (F.col("ord") + F.col("step.o")).alias("ord"), (F.col("rank") * (2 * radius + 1) + F.col("step.p")).alias("p"))
    e = e.join(n, list(RESPONSE)).where("ord >= 0 and ord < n")
    return e.groupBy(*RESPONSE, "ord").agg(F.min("p").alias("priority"))


def greedy(items: Column, budget: int, separator: int) -> Column:
    """Walks structs (priority..., ord, text) in order; takes what fits, skips what doesn't; a first one too long gives its prefix.

    Returns struct(used, sel array<struct<ord, text>>, done).
    """
    empty = F.expr("cast(array() as array<struct<ord:int,text:string>>)")
    first = F.struct(F.lit(0).alias("used"), empty.alias("sel"), F.lit(None).cast("string").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        cost = F.length(x["text"]) + F.when(F.size(acc["sel"]) > 0, separator).otherwise(0)
        fits = acc["used"] + cost <= budget
        one = F.array(F.struct(x["ord"].cast("int").alias("ord"), x["text"].alias("text")))
        taken = F.struct((acc["used"] + cost).alias("used"), F.concat(acc["sel"], one).alias("sel"), acc["done"].alias("done"))
        cut = F.struct(acc["used"].alias("used"), acc["sel"].alias("sel"), F.substring(x["text"], 1, budget).alias("done"))
        return F.when(acc["done"].isNotNull() | (x["text"] == ""), acc).when(fits, taken).when(F.size(acc["sel"]) == 0, cut).otherwise(acc)

    return F.aggregate(items, first, step)


def joined(state: Column) -> Column:
    """The chosen texts in order of position."""
    return F.coalesce(state["done"], F.array_join(F.transform(F.array_sort(state["sel"]), lambda x: x["text"]), "\n"))


def join_chunks(chunks: Column, budget: int) -> Column:
    """Texts joined by line breaks within a budget; a break that nothing follows is dropped."""
    whole = F.array_join(F.filter(chunks, lambda c: c != ""), "\n")
    cut = F.substring(whole, 1, budget)
    return F.when((F.length(whole) > budget) & cut.endswith("\n"), F.substring(cut, 1, budget - 1)).otherwise(cut)


def for_all(s: DataFrame, found: DataFrame, *names: str) -> DataFrame:
    """A row for each response of s; names are empty texts where found has none."""
    return s.select(*RESPONSE).distinct().join(found, list(RESPONSE), "left").select(*RESPONSE, *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def context(s: DataFrame, b: Budgets) -> DataFrame:
    """objective_context of each response; empty without an anchor."""
    e = neighbours(s, b.top_k, b.radius).join(s.select(*RESPONSE, "ord", "rendered"), [*RESPONSE, "ord"])
    items = F.array_sort(F.collect_list(F.struct("priority", "ord", F.col("rendered").alias("text"))))
    return for_all(s, e.groupBy(*RESPONSE).agg(joined(greedy(items, b.context, 1)).alias("objective_context")), "objective_context")


def role_texts(s: DataFrame, b: Budgets) -> DataFrame:
    """The best lines of tutor and student within the role budget: tutor_relevant and student_relevant of each response."""
    roles = ("tutor", "student")
    a = anchors(s, b.top_k, by_role=True).where(F.col("role").isin(*roles))
    items = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("rank", "ord", F.col("rendered").alias("text")))))
    found = a.groupBy(*RESPONSE).agg(*[joined(greedy(items(r), b.role, 1)).alias(f"{r}_relevant") for r in roles])
    return for_all(s, found, *[f"{r}_relevant" for r in roles])


def window_ends(s: DataFrame, gap: int, kind: str, keys: tuple[str, ...] = RESPONSE) -> DataFrame:
    """Lines with starts (whether a window may start here) and hit, the first fitting line of the next gap lines."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(1, gap)
    hit = (F.col("role") == "student") & F.col("ne") if kind == "qa" else (F.col("role") == "tutor") & F.col("ne") & (F.col("fb") | F.col("co"))
    start = (F.col("role") == "tutor") & F.col("q") if kind == "qa" else (F.col("role") == "student") & F.col("ne")
    kept = [c for c in ("ord", "rendered", "ovl") if c in s.columns]
    return s.withColumn("hit", F.first(F.when(hit, F.struct(*kept)), ignorenulls=True).over(w)).withColumn("starts", start)


def window_text() -> Column:
    return F.concat_ws("\n", "rendered", "hit.rendered")


def windows(s: DataFrame, gap: int, kind: str) -> DataFrame:
    """Question and answer (`qa`) or answer and feedback (`feedback`): the first fitting line of the next gap lines."""
    d = window_ends(s, gap, kind).where(F.col("starts") & F.col("hit").isNotNull())
    return d.select(*RESPONSE, F.col("ord").alias("start"), F.col("hit.ord").alias("stop"), (F.col("ovl") + F.col("hit.ovl")).alias("score"), window_text().alias("text"))


def select_windows(w: DataFrame, budget: int, s: DataFrame | None = None, name: str = "windows_text") -> DataFrame:
    """The best windows within a budget, for the responses of s (or of the windows alone)."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("r"), F.col("start").alias("ord"), "text")))
    found = w.groupBy(*RESPONSE).agg(joined(greedy(items, budget, 2)).alias(name))
    return found if s is None else for_all(s, found, name)


def edges(s: DataFrame, b: Budgets) -> DataFrame:
    """Opening and closing lines that are not empty, within the edge budget."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("ne"), F.struct("ord", "rendered")))), lambda x: x["rendered"])
    d = s.groupBy(*RESPONSE).agg(lines.alias("_l"))
    n = F.lit(b.edge_lines)
    return d.select(*RESPONSE, join_chunks(F.slice("_l", F.lit(1), n), b.edges).alias("opening"), join_chunks(F.slice("_l", F.greatest(F.size("_l") - n + 1, F.lit(1)), n), b.edges).alias("closing"))


def response_texts(s: DataFrame, views: DataFrame, b: Budgets = Budgets()) -> DataFrame:
    """The ten texts of each response: four of its session's view, and six chosen for its objective.

    s: scored lines; views: session_id, full_text, tutor_text and student_text; objective comes with s.
    """
    keys = list(RESPONSE)
    d = s.groupBy(*keys).agg(F.first("objective").alias("learning_objective")).join(views.select("session_id", "full_text", "tutor_text", "student_text"), "session_id")
    parts = [context(s, b), role_texts(s, b), *[select_windows(windows(s, b.max_gap, kind), b.window, s, f"{kind}_text") for kind in ("qa", "feedback")], for_all(s, edges(s, b), "opening", "closing")]
    for part in parts:
        d = d.join(part, keys)
    return d
