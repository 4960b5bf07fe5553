"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake import catalog_sql as S
from convolake.functions import text as X
from convolake.functions.lexicon import STOPWORDS
from convolake.operators import action_graph as G
from convolake.operators import dense as D
from convolake.operators import evaluation as E
from convolake.operators import evidence as V
from convolake.operators import products as P
from convolake.operators import relational as R
from convolake.operators import sessions as C
from convolake.operators import vectors as N
from convolake.plans import audits as A
from convolake.plans import modeling as M
from convolake.sources import tables as T
from convolake.streaming import sessions as ST

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, rounds: tuple[str, ...] | None = None):
    """Registers a query under its function's name; doubles (or rounds, if others are whole or rounded already) are rounded to 6 digits where SQL checks them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*[F.round(F.col(c), 6).alias(c) if t in ("double", "float") and (rounds is None or c in rounds) else F.col(c) for c, t in df.dtypes])

        run.__name__ = f.__name__
        FOUND[f.__name__] = (run, sql)
        return run

    return add


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}


# ---- relations ------------------------------------------------------------------------------


def views(t) -> DataFrame:
    return C.session_views(C.transcript(t("conversations")))


def lines(t) -> DataFrame:
    return C.ordered_lines(C.transcript(t("conversations")), S.LEX)


def responses(t) -> DataFrame:
    """Each conversation with two items of benchmark, dealt over all of them."""
    n = F.broadcast(t("benchmark").agg(F.count("*").alias("_n")))  # one row
    pairs = t("conversations").select(F.col("conv_id").alias("session_id")).distinct().crossJoin(n)
    pairs = pairs.select("session_id", F.explode(F.array_distinct(F.array(F.col("session_id") % F.col("_n"), (F.col("session_id") + 7) % F.col("_n")))).alias("objective_id"))
    return pairs.join(t("benchmark").select(F.col("item_id").alias("objective_id"), F.col("text").alias("objective")), "objective_id")


def scored(t) -> DataFrame:
    return V.scored(lines(t), responses(t))


def items(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("objective_id"), F.col("text").alias("objective"))


def scored_all(t) -> DataFrame:
    """Every conversation with every item of benchmark."""
    return V.scored_all(lines(t), items(t))


def probabilities(t) -> DataFrame:
    """Rows with a label y, three heads, a session and a group."""
    d = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return d.select(F.col("l_orderkey").alias("session"), F.col("p_brand").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (0.05 + F.col("l_discount") * 9).alias("p1"), (F.col("l_tax") * 10 + 0.1).alias("p2"), (F.col("l_quantity") / 51).alias("p3"))


# ---- session views ---------------------------------------------------------------------------


@query(S.views("session_id, utterance_count, char_count, word_count, " + ", ".join(f"{r}_{k}_count" for r in C.ROLES for k in ("utterance", "char", "word"))))
def session_views_counts(t):
    return views(t).select("session_id", "utterance_count", "char_count", "word_count", *[f"{r}_{k}_count" for r in C.ROLES for k in ("utterance", "char", "word")])


@query(S.views("session_id, " + ", ".join(f"{S.ratio(f'{r}_{k}_count', f'{k}_count')} AS {r}_{k}_ratio" for r in C.ROLES for k in ("utterance", "char", "word"))))
def session_views_ratios(t):
    return views(t).select("session_id", *[f"{r}_{k}_ratio" for r in C.ROLES for k in ("utterance", "char", "word")])


@query(S.views("session_id, full_text, tutor_text, student_text, background_text"))
def session_views_texts(t):
    return views(t).select("session_id", "full_text", "tutor_text", "student_text", "background_text")


@query(S.views("session_id, opening_text, closing_tutor_text, closing_student_text"))
def opening_closing_slices(t):
    return views(t).select("session_id", "opening_text", "closing_tutor_text", "closing_student_text")


@query(S.views(f"session_id, role_transition_count, {S.ratio('role_transition_count', 'utterance_count - 1')} AS role_transition_ratio"))
def session_role_transitions(t):
    return views(t).select("session_id", "role_transition_count", "role_transition_ratio")


@query(S.views(f"session_id, short_student_count, {S.ratio('short_student_count', 'student_utterance_count')} AS short_student_ratio, question_count, {S.ratio('question_count', 'utterance_count')} AS question_ratio"))
def session_short_lines(t):
    return views(t).select("session_id", "short_student_count", "short_student_ratio", "question_count", "question_ratio")


@query(S.views(f"session_id, unclear_student_count, {S.ratio('unclear_student_count', 'student_utterance_count')} AS unclear_student_ratio, feedback_proxy_count, {S.ratio('feedback_proxy_count', 'tutor_utterance_count')} AS feedback_proxy_ratio, correction_proxy_count, {S.ratio('correction_proxy_count', 'tutor_utterance_count')} AS correction_proxy_ratio"))
def session_regex_proxies(t):
    return views(t).select("session_id", *[f"{n}_{k}" for n in ("unclear_student", "feedback_proxy", "correction_proxy") for k in ("count", "ratio")])


@query(S.DURATION)
def session_duration_events(t):
    e = t("events").select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("utterance_id"), F.col("event_type").alias("role"), F.col("props").alias("content"), F.concat(F.lit("0:"), F.date_format("ts", "mm:ss")).alias("timestamp"))
    return C.session_views(e).select("session_id", "utterance_count", "duration_seconds", "role_transition_count")


# ---- text ------------------------------------------------------------------------------------


@query(S.NORMALIZE)
def normalize_text(t):
    return t("documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))


@query(S.TOKENS)
def tokenize_counts(t):
    toks = X.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_unique"), F.array_join(F.slice(toks, 1, 20), " ").alias("head"), X.word_count(F.col("text")).alias("n_words"))


@query(S.STOPWORDS_SQL)
def stopword_filter(t):
    return t("documents").select("doc_id", F.array_join(V.objective_tokens(F.col("text")), " ").alias("kept"), F.size(X.without(X.tokens(F.col("text")), STOPWORDS)).cast("long").alias("n_kept"))


@query(S.CLOCK)
def clock_parse(t):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("1:61:00")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "HH:mm:ss.SSS")))
    return t("events").select("event_id", X.clock_seconds(text).alias("seconds"))


@query(S.lines("SELECT session_id, count(*) FILTER (WHERE q)::BIGINT AS n_questions, count(*) FILTER (WHERE q AND role = 'tutor')::BIGINT AS n_tutor_questions FROM lines GROUP BY session_id"))
def question_lines(t):
    return lines(t).groupBy("session_id").agg(F.count_if("q").alias("n_questions"), F.count_if(F.col("q") & (F.col("role") == "tutor")).alias("n_tutor_questions"))


@query(S.lines("SELECT session_id, ord, fb, co, re, un FROM lines"))
def phrase_lines(t):
    return lines(t).select("session_id", F.col("ord").cast("long").alias("ord"), "fb", "co", "re", "un")


@query(S.lines("SELECT session_id, ord, role, rendered FROM lines"))
def ordered_lines(t):
    return lines(t).select("session_id", F.col("ord").cast("long").alias("ord"), "role", "rendered")


# ---- evidence --------------------------------------------------------------------------------

KEYS = list(V.RESPONSE)


def evidence(rest: str, recursive: bool = False, product: Callable[[DataFrame, DataFrame], DataFrame] | None = None, rounds: tuple[str, ...] | None = None):
    """Registers a query over scored lines: over two objectives a conversation, and as NAME_x_benchmark over all.

    product: the same of lines and objectives, without a row for each pair of them on the way.
    """

    def add(f):
        def paired(t):
            return f(scored(t))

        def every(t):
            return product(lines(t), items(t)) if product else f(scored_all(t))

        paired.__name__, every.__name__ = f.__name__, f"{f.__name__}_x_benchmark"
        query(S.scored(rest, recursive))(paired)
        query(S.scored_all(rest, recursive), rounds)(every)
        return f

    return add


@evidence("SELECT session_id, objective_id, ord, round(ovl, 6) AS ovl FROM s", product=P.overlaps)
def line_overlap_scores(s):
    return s.select(*KEYS, F.col("ord").cast("long").alias("ord"), "ovl")


@evidence("SELECT session_id, objective_id, ord, rank FROM anchors", product=lambda l, o: P.anchors(l, o, S.K))
def anchor_topk(s):
    return V.anchors(s, S.K).select(*KEYS, F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


@evidence(f"SELECT session_id, objective_id, role, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id, role ORDER BY ovl DESC, ord) AS rank FROM s WHERE ovl > 0) WHERE rank <= {S.K}")
def anchor_topk_by_role(s):
    return V.anchors(s, S.K, by_role=True).select(*KEYS, "role", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


@evidence("SELECT session_id, objective_id, ord, priority FROM near")
def neighbor_expansion(s):
    return V.neighbours(s, S.K, S.BUDGETS.radius).select(*KEYS, F.col("ord").cast("long").alias("ord"), F.col("priority").cast("long").alias("priority"))


@evidence(S.greedy(S.CONTEXT_ITEMS, S.BUDGETS.context, 1, "objective_context"), recursive=True, product=lambda l, o: P.context(l, o, S.BUDGETS))
def budget_select_context(s):
    return V.context(s, S.BUDGETS)


@evidence(S.role_texts(), recursive=True)
def budget_role_text(s):
    return V.role_texts(s, S.BUDGETS)


@evidence(S.EDGES)
def budget_join_chunks(s):
    return V.edges(s, S.BUDGETS)


def _long_ends(w):
    return w.select(*KEYS, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "score", "text")


@evidence(S.windows("qa") + " SELECT session_id, objective_id, start, stop, round(score, 6) AS score, text FROM win", product=lambda l, o: _long_ends(P.windows(l, o, S.BUDGETS.max_gap, "qa")))
def qa_windows(s):
    return _long_ends(V.windows(s, S.BUDGETS.max_gap, "qa"))


@evidence(S.windows("feedback") + " SELECT session_id, objective_id, start, stop, round(score, 6) AS score, text FROM win", product=lambda l, o: _long_ends(P.windows(l, o, S.BUDGETS.max_gap, "feedback")))
def feedback_windows(s):
    return _long_ends(V.windows(s, S.BUDGETS.max_gap, "feedback"))


@evidence(S.windows("feedback") + S.greedy(S.WINDOW_ITEMS, S.BUDGETS.window, 2, "windows_text"), recursive=True, product=lambda l, o: P.window_texts(l, o, S.BUDGETS, "feedback"))
def budget_windows(s):
    return V.select_windows(V.windows(s, S.BUDGETS.max_gap, "feedback"), S.BUDGETS.window, s)


@query(S.scored(S.response_texts(), recursive=True))
def response_texts(t):
    return V.response_texts(scored(t), views(t), S.BUDGETS)


# ---- dense features --------------------------------------------------------------------------


@evidence(S.DENSE_MATCH, product=P.match_features, rounds=P.MEANS)
def dense_match(s):
    return D.match_features(s)


@query(S.lines(S.DENSE_VOLUME))
def dense_volume(t):
    return D.volume_features(lines(t))


@query(S.lines(S.dense_segments()))
def dense_segments(t):
    d = D.segment_features(lines(t))
    return d.select("session_id", *[c for c in d.columns if c.split("_")[0] in D.SEGMENTS])


@query(S.lines(S.dense_segments(deltas=True)))
def dense_deltas(t):
    d = D.segment_features(lines(t))
    return d.select("session_id", *[c for c in d.columns if c.endswith("_minus_early")])


@query(S.scored(S.dense_all(), recursive=True))
def dense_all(t):
    return D.dense_features(scored(t), lines(t), S.BUDGETS)


@query(S.scored_all(S.dense_all(), recursive=True), rounds=P.MEANS)
def dense_all_x_benchmark(t):
    return P.dense_features(lines(t), items(t), S.BUDGETS)


# ---- action graph ----------------------------------------------------------------------------


def actions(t) -> DataFrame:
    return G.labelled(lines(t), S.LEX)


@query(S.lines(S.ACTIONS + S.GRAPH_COUNTS))
def graph_counts(t):
    return G.action_counts(actions(t))


@query(S.lines(S.ACTIONS + S.GRAPH_RUNS))
def graph_runs(t):
    d = actions(t)
    return G.longest_run(d, F.arrays_overlap("actions", F.array(F.lit("hint"), F.lit("question"))), "hint_depth").join(G.longest_run(d, F.array_contains("actions", "correction"), "correction_chain_length"), "session_id")


@query(S.scored(S.CONCEPTS + " SELECT * FROM ct"))
def concept_transitions(t):
    return G.concept_transitions(lines(t), responses(t), STOPWORDS)


@query(S.scored(S.graph_all()))
def graph_all(t):
    return G.response_graph(lines(t), actions(t), responses(t), STOPWORDS)


@query(S.EVENT_RUNS)
def event_runs(t):
    e = t("events").select(F.col("user_id").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at"), "event_type")
    return G.longest_run(e, F.col("event_type") == "click", "longest_clicks").join(G.flips(e, F.col("event_type") == "click", "n_flips"), "session_id")


@query(S.lines(S.ACTIONS + S.GRAPH_EDGES))
def graph_edges_density(t):
    return G.graph_shape(actions(t))


@query(S.lines(S.ACTIONS + S.GRAPH_PERSISTENCE))
def graph_persistence(t):
    return G.persistence(actions(t))


@query(S.lines(S.ACTIONS + S.GRAPH_THIRDS))
def graph_thirds(t):
    return G.thirds(actions(t))


# ---- keys and joins --------------------------------------------------------------------------


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_join(t):
    return R.one_to_one(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")


@query("SELECT doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_set_equality(t):
    return R.key_difference(t("documents"), t("labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_report(t):
    return R.duplicate_keys(t("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name, unnest([count(*) FILTER (WHERE doc_id IS NULL), count(*) FILTER (WHERE text IS NULL OR text = ''), count(*) FILTER (WHERE lang IS NULL OR lang = ''), count(*) FILTER (WHERE source IS NULL OR source = ''), count(*) FILTER (WHERE n_chars IS NULL)])::BIGINT AS n_missing FROM documents")
def nonempty_report(t):
    return R.null_or_empty(t("documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def purge_anti_join(t):
    return R.purge(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t("customer").where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dimension_map(t):
    return R.map_dimension(t("supplier").select("s_suppkey", "s_nationkey"), t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "n_name").select("s_suppkey", "s_nationkey", "n_name")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_id, o_orderkey, o_custkey FROM orders")
def row_id_assignment(t):
    return R.with_row_id(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("row_id", "o_orderkey", "o_custkey")


@query("SELECT o_custkey % 64 AS part, sha256(string_agg(sha256(concat(o_orderkey, '|', o_custkey, '|', o_orderstatus)), '' ORDER BY o_orderkey)) AS digest, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def identity_digest(t):
    d = t("orders").select("o_orderkey", (F.col("o_custkey") % 64).alias("part"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").cast("binary"), 256).alias("h"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "h"))), lambda x: x["h"])
    return d.groupBy("part").agg(F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


@query("SELECT DISTINCT role, substr(text, 1, 8) AS head FROM conversations")
def distinct_pairs(t):
    return t("conversations").select("role", F.substring("text", 1, 8).alias("head")).distinct()


@query("SELECT DISTINCT role, text FROM conversations")
def distinct_role_texts(t):
    return t("conversations").select("role", "text").distinct()


@query("SELECT c_custkey, unnest(['F', 'O', 'P']) AS status FROM customer EXCEPT SELECT o_custkey, o_orderstatus FROM orders")
def set_difference(t):
    every = t("customer").select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("status"))
    return every.subtract(t("orders").select("o_custkey", "o_orderstatus"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 3")
def topk_per_group(t):
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return t("events").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("user_id", "event_id", "rank")


@query(S.PROFILE)
def table_profile(t):
    return T.profile(t("events")).select("column_name", "n_rows", "n_missing")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props_flatten(t):
    parsed = t("events").select("event_id", F.from_json("props", "k long").alias("props"))
    return T.flatten(parsed).select("event_id", F.col("`props.k`").alias("k"))


# ---- folds and metrics -----------------------------------------------------------------------


@query(S.FOLDS + " SELECT grp, pos, size, fold FROM folds")
def fold_snake(t):
    return E.snake_folds(probabilities(t), "grp", "y", 5)


@query(S.FOLDS + " SELECT split, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos FROM (SELECT p.*, CASE WHEN fold = 0 THEN 'validation' WHEN session IN (SELECT session FROM p JOIN folds USING (grp) WHERE fold = 0) THEN 'purged' ELSE 'train' END AS split FROM p JOIN folds USING (grp)) GROUP BY split")
def fold_purge(t):
    d = probabilities(t)
    return E.splits(d, E.snake_folds(d, "grp", "y", 5), "grp", "session", 0).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@query(S.ISOLATION)
def fold_isolation(t):
    """Sessions and groups that train and validation share, after the purge and before it."""
    d = probabilities(t)
    s = E.splits(d, E.snake_folds(d, "grp", "y", 5), "grp", "session", 0)
    before = E.isolation_faults(s.withColumn("split", F.when(F.col("split") == "purged", "train").otherwise(F.col("split"))), "session", "grp").withColumnRenamed("n_shared", "n_before")
    return E.isolation_faults(s, "session", "grp").join(before, "key")


@query(S.folds_of("substr(p_brand, 1, 7)") + S.SPLIT + " SELECT split, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos FROM sp GROUP BY split")
def family_folds(t):
    d = probabilities(t)
    families = d.select("grp", F.substring("grp", 1, 7).alias("family")).distinct()
    f = E.family_folds(d, families, "grp", "y", 5)
    return E.splits(f.drop("fold"), f.select("family", "fold").distinct(), "family", "session", 0).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@query(S.folds_of("l_orderkey") + " SELECT fold, count(*)::BIGINT AS n_groups, sum(size)::BIGINT AS n, sum(pos)::BIGINT AS pos FROM folds GROUP BY fold")
def session_folds(t):
    return E.snake_folds(probabilities(t), "session", "y", 5).groupBy("fold").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n"), F.sum("pos").alias("pos"))


@query()
def stratified_folds(t):
    return E.stratified_folds(probabilities(t), "grp", "y", 5)


@query()
def nested_platt(t):
    d = labelled_vectors(t).select("vec_id", "grp", "session", "y", (0.1 + 0.8 / (1 + F.exp(-(F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1))).cast("double") * 4))).alias("p"))
    return M.nested_platt(d, E.snake_folds(d, "grp", "y", 3), "grp", "session", "p", "y", 3).select("vec_id", "fold", "calibrated")


@query(S.FOLDS + " SELECT fold, round(avg(y), 6) AS prior FROM p JOIN folds USING (grp) GROUP BY fold")
def fold_prior(t):
    d = probabilities(t)
    return d.join(E.snake_folds(d, "grp", "y", 5).select("grp", "fold"), "grp").groupBy("fold").agg(F.avg("y").alias("prior"))


@query(S.PROBS + f" SELECT round({S.log_loss('p3')}, 6) AS log_loss, round(avg((p3 - y) * (p3 - y)), 6) AS brier FROM p")
def metric_logloss_brier(t):
    return probabilities(t).agg(E.log_loss(F.col("y"), F.col("p3")).alias("log_loss"), E.brier(F.col("y"), F.col("p3")).alias("brier"))


@query(S.PROBS + S.AUC)
def metric_auc(t):
    return E.roc_auc(probabilities(t).select("grp", "y", F.col("p3").alias("p")), "grp")


@query(S.PROBS + " SELECT grp, round(sum(n * abs(y - q)) / sum(n), 6) AS ece FROM (SELECT grp, least(floor(p3 * 10), 9) AS bin, count(*) AS n, avg(y) AS y, avg(p3) AS q FROM p GROUP BY 1, 2) GROUP BY grp")
def metric_ece10(t):
    return E.ece(probabilities(t).select("grp", "y", F.col("p3").alias("p")), 10, "grp")


@query(S.FOLDS + f", f AS (SELECT fold, {S.log_loss('p3')} AS ll FROM p JOIN folds USING (grp) GROUP BY fold) SELECT round(avg(ll), 6) AS mean, round(stddev_pop(ll), 6) AS std, round(max(ll), 6) AS worst FROM f")
def fold_dispersion(t):
    d = probabilities(t)
    f = d.join(E.snake_folds(d, "grp", "y", 5).select("grp", "fold"), "grp").groupBy("fold").agg(E.log_loss(F.col("y"), F.col("p3")).alias("ll"))
    return M.dispersion(f, "ll")


@query(S.PROBS + f" SELECT session, round({S.platt('p3', 1.3, -0.2)}, 6) AS q, count(*)::BIGINT AS n FROM p GROUP BY 1, 2")
def platt_apply(t):
    return probabilities(t).select("session", F.round(E.platt(F.col("p3"), 1.3, -0.2), 6).alias("q")).groupBy("session", "q").agg(F.count("*").alias("n"))


@query(S.PROBS + f" SELECT session, round({S.BLEND}, 6) AS q, count(*)::BIGINT AS n FROM p GROUP BY 1, 2")
def blend_clip(t):
    d = probabilities(t)
    return d.select("session", F.round(E.blend([(F.col("p1"), 0.25), (F.col("p2"), 0.25), (F.col("p3"), 0.5)]), 6).alias("q")).groupBy("session", "q").agg(F.count("*").alias("n"))


def losses(d: DataFrame, *keys: str) -> DataFrame:
    d = d.withColumn("pe", E.blend([(F.col("p1"), 0.25), (F.col("p2"), 0.25), (F.col("p3"), 0.5)])).withColumn("p0", F.lit(0.33))
    return d.groupBy(*keys).agg(*[E.log_loss(F.col("y"), F.col(c)).alias(c) for c in ("p0", "p1", "p2", "p3", "pe")])


@query(S.GATE)
def promotion_gate(t):
    d = probabilities(t)
    f = losses(d.join(E.snake_folds(d, "grp", "y", 5).select("grp", "fold"), "grp"), "fold")
    return f.agg(F.bool_and(F.col("pe") < F.least("p0", "p1", "p2", "p3")).alias("passed"), F.max_by("fold", "pe").alias("worst_fold"), F.max("pe").alias("worst"))


@query(S.ABLATION)
def ablation_delta(t):
    d = probabilities(t)
    return losses(d, "grp").select("grp", (F.col("pe") - F.col("p3")).alias("delta"))


# ---- vectors and models ----------------------------------------------------------------------


@query(S.HASHED)
def hashed_ngrams_l2(t):
    return N.hashed_ngrams(t("documents"), "doc_id", X.tokens(F.col("text")), 1024)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1 / sqrt(2), 6) AS l_quantity, round((l_discount - m2) / s2 / sqrt(2), 6) AS l_discount FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM lineitem)")
def dense_scaler_geometry(t):
    return N.scale(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])


@query("SELECT vec_id, round(e[1]::DOUBLE / n, 6) AS first, round(e[64]::DOUBLE / n, 6) AS last, round(n, 6) AS norm FROM (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def l2_normalize(t):
    unit = N.l2_normalize(F.col("embedding"))
    return t("embeddings").select("vec_id", F.get(unit, F.lit(0)).alias("first"), F.get(unit, F.lit(63)).alias("last"), F.sqrt(N.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


def gathered(t) -> DataFrame:
    e = t("embeddings")
    o = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("objective"))
    return e.join(o, "label").select("vec_id", "label", N.l2_normalize(F.col("embedding")).alias("c"), N.l2_normalize(F.col("objective")).alias("o"))


@query(S.GATHERED + " SELECT vec_id, label, round(o[1], 6) AS o1 FROM g")
def objective_gather(t):
    return gathered(t).select("vec_id", "label", F.get("o", F.lit(0)).alias("o1"))


@query(S.GATHERED + " SELECT vec_id, round(list_sum(list_transform(list_zip(c, o), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(list_sum(list_transform(list_zip(c, o), lambda p: p[1] * p[2])), 6) AS cosine, 257::BIGINT AS width FROM g")
def semantic_interactions(t):
    m = gathered(t).select("vec_id", N.interactions(F.col("c"), F.col("o")).alias("m"))
    part = lambda lo, n: F.aggregate(F.slice("m", lo, n), F.lit(0.0), lambda a, x: a + x)
    return m.select("vec_id", part(129, 64).alias("l1"), F.get("m", F.lit(256)).alias("cosine"), F.size("m").cast("long").alias("width"))


@query(S.LLOYD)
def lloyd_step(t):
    e = t("embeddings")
    centres = e.where("vec_id < 5").select(F.col("vec_id").cast("int").alias("cluster"), F.col("embedding").alias("centre"))
    return N.lloyd_step(e, centres)


@query("SELECT user_id, session_start, n_events, total, duration_us FROM (SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n_events, round(sum(coalesce(value, 0)), 4) AS total, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS duration_us FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, sid)")
def session_windows(t):
    return ST.session_windows(t("events"))


def labelled_vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.col("label").cast("string").alias("grp"), F.expr("vec_id div 4").alias("session"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("y"), "embedding")


@query(S.GATHERED + " SELECT vec_id, 259::BIGINT AS width, round(list_sum(list_transform(list_zip(c, o), lambda p: p[1] * p[2])), 6) AS cosine, label::DOUBLE AS first_dense, (vec_id % 7)::DOUBLE AS last_dense FROM g")
def semantic_interactions_dense(t):
    m = gathered(t).select("vec_id", N.interactions(F.col("c"), F.col("o"), F.array(F.col("label").cast("double"), (F.col("vec_id") % 7).cast("double"))).alias("m"))
    return m.select("vec_id", F.size("m").cast("long").alias("width"), F.get("m", F.lit(256)).alias("cosine"), F.get("m", F.lit(257)).alias("first_dense"), F.get("m", F.lit(258)).alias("last_dense"))


@query(S.response_hashes({"full_text": 1 << 19}, 1 << 16))
def full_text_hash(t):
    return N.response_hashes(responses(t), views(t), items(t), {"full_text": 1 << 19}, 1 << 16)


@query(S.response_hashes({"tutor_text": 1 << 18, "student_text": 1 << 18}, 1 << 16))
def role_text_hash(t):
    return N.response_hashes(responses(t), views(t), items(t), {"tutor_text": 1 << 18, "student_text": 1 << 18}, 1 << 16)


@query("SELECT o_orderkey AS k, bucket, value FROM (SELECT o_orderkey, o_custkey % 8 AS bucket, 1::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 8, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) FROM orders)")
def append_scaled_dense(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 8).alias("bucket"), F.lit(1.0).alias("value"), "o_totalprice")
    return N.append_dense(o.select("k", "bucket", "value"), o.select("k", "o_totalprice"), ["k"], ["o_totalprice"], 8)


@query()
def encodeitems(t):
    e = N.encode_once(items(t), "objective_id", "objective", N.hashing_encoder(16), 16)
    return e.select("objective_id", N.dot(F.col("vector"), F.col("vector")).alias("norm"), F.get("vector", F.lit(0)).cast("double").alias("first"))


@query(f"SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 64 AS part, count(*)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY o_orderkey)) AS digest FROM (SELECT o_orderkey, sha256(concat({S.field('o_orderkey')}, {S.field('o_custkey')}, {S.field('o_orderstatus')})) AS h FROM orders) GROUP BY 1")
def table_digests(t):
    return A.table_digest(t("orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT count(*) FILTER (WHERE r.k IS NULL)::BIGINT AS only_left, count(*) FILTER (WHERE l.k IS NULL)::BIGINT AS only_right, count(*) FILTER (WHERE l.s <> r.s)::BIGINT AS different, count(*) FILTER (WHERE l.s = r.s)::BIGINT AS same FROM (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 0) l FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 'other' ELSE c_mktsegment END AS s FROM customer WHERE c_acctbal < 9000) r ON l.k = r.k")
def table_parity(t):
    c = t("customer")
    return A.parity(c.where("c_acctbal > 0"), c.where("c_acctbal < 9000").withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 3, "other").otherwise(F.col("c_mktsegment"))), "c_custkey", ["c_mktsegment"])


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS n_distinct, min(event_id) AS lowest, max(event_id) AS highest, count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AS contiguous FROM events")
def contiguous_ids(t):
    return A.contiguous(t("events"), "event_id")


@query("SELECT unnest(['l_quantity', 'l_tax']) AS column_name, unnest([count(*) FILTER (WHERE l_quantity IS NULL OR NOT isfinite(l_quantity)), count(*) FILTER (WHERE l_tax IS NULL OR NOT isfinite(l_tax))])::BIGINT AS n_bad FROM lineitem")
def finite_columns(t):
    return A.finite_report(t("lineitem"), ["l_quantity", "l_tax"])


@query("SELECT unnest(['response without view', 'view without lines', 'lines without view', 'line counts differ', 'characters differ', 'repeated sessions']) AS \"check\", unnest([0, 0, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 3 = 0), (SELECT count(*) FROM (SELECT conv_id FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id HAVING count(*) FILTER (WHERE turn > 0) <> count(*))), (SELECT count(*) FROM (SELECT conv_id FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id HAVING sum(length(text)) FILTER (WHERE turn > 0) <> sum(length(text)))), 0])::BIGINT AS n_bad")
def view_audit(t):
    """An audit that has something to find: views that lack a third of the sessions, over transcripts that lost their first lines."""
    v = views(t).where("session_id % 3 <> 0")
    tr = C.transcript(t("conversations"))
    kept = tr.where(F.col("utterance_id").cast("long") > 0)
    return A.view_audit(v.select("session_id"), v, kept)


@query()
def lr_head_oof(t):
    return M.out_of_fold(labelled_vectors(t), "embedding", "y", "grp", "session").select("vec_id", "fold", "y", "probability")


@query()
def kmeans_families(t):
    return M.families(t("embeddings"), 10, 0)


@query()
def predict_pipeline(t):
    d = labelled_vectors(t).withColumnRenamed("vec_id", "response_id").withColumn("half", F.slice("embedding", 1, 32))
    heads = [(M.fit_head(d, c, "y"), c, 0.5) for c in ("half", "embedding")]
    return M.predict(d, heads)
