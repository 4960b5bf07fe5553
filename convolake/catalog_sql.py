"""SQL that gives the rows of the catalog's queries, and the parameters both share."""

from __future__ import annotations

import re

from convolake.functions.lexicon import CORRECTION_PATTERN, FEEDBACK_PATTERN, QUESTION_STARTERS, STOPWORDS, UNCLEAR_PATTERN, Budgets, Lexicon
from convolake.functions.text import SPACES, TOKEN

#: Lists and limits that find something in invented text.
LEX = Lexicon(feedback=("the", "and"), correction=("no", "of the", "de"), reasoning=("then", "in", "la"), uncertainty=("is", "to", "die"), hint=("that",), explanation=("for", "on"), confidence=("it", "le"), action_reasoning=("then", "in"), action_uncertainty=("is", "to"))
BUDGETS = Budgets(context=700, role=400, window=900, edges=300, top_k=3, radius=1, edge_lines=3, max_gap=4)
K = BUDGETS.top_k


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END, 6)"


def fold(x: str) -> str:
    return f"replace(lower(replace(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'), 'ſ', 's')), '’', '''')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, {quote(TOKEN)})"


def normal(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {quote(SPACES)}, ' ', 'g'), ' ')"


def between(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote('(?i)(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:' + pattern + ')([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')})"


ROLE = "CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor' WHEN 'system' THEN 'background' ELSE 'other' END"


def views(columns: str) -> str:
    roles = ("tutor", "student", "background")
    words = r"len(regexp_extract_all(content, '[\p{L}\p{N}_]+'))"
    counts = ", ".join(f"count(*) FILTER (WHERE role = '{r}')::BIGINT AS {r}_utterance_count, coalesce(sum(length(content)) FILTER (WHERE role = '{r}'), 0)::BIGINT AS {r}_char_count, coalesce(sum(words) FILTER (WHERE role = '{r}'), 0)::BIGINT AS {r}_word_count, coalesce(string_agg(content, chr(10) ORDER BY ord) FILTER (WHERE role = '{r}'), '') AS {r}_text" for r in roles)
    closing = ", ".join(f"coalesce(string_agg(content, chr(10) ORDER BY ord) FILTER (WHERE role = '{r}' AND back <= 3), '') AS closing_{r}_text" for r in roles[:2])
    return f"""WITH raw AS (SELECT conv_id AS session_id, turn, {ROLE} AS role, text AS content FROM conversations),
    l AS (SELECT *, {words} AS words, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS ord, row_number() OVER (PARTITION BY session_id, role ORDER BY turn DESC) AS back, lag(role) OVER (PARTITION BY session_id ORDER BY turn) AS prev FROM raw),
    v AS (SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY ord) AS full_text, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY ord) FILTER (WHERE ord < 8) AS opening_text, {counts}, {closing},
      count(*)::BIGINT AS utterance_count, sum(length(content))::BIGINT AS char_count, sum(words)::BIGINT AS word_count, count(*) FILTER (WHERE prev <> role)::BIGINT AS role_transition_count,
      count(*) FILTER (WHERE role = 'student' AND words <= 5)::BIGINT AS short_student_count, count(*) FILTER (WHERE contains(content, '?'))::BIGINT AS question_count,
      count(*) FILTER (WHERE role = 'student' AND {between('content', UNCLEAR_PATTERN)})::BIGINT AS unclear_student_count, count(*) FILTER (WHERE role = 'tutor' AND {between('content', FEEDBACK_PATTERN)})::BIGINT AS feedback_proxy_count, count(*) FILTER (WHERE role = 'tutor' AND {between('content', CORRECTION_PATTERN)})::BIGINT AS correction_proxy_count
      FROM l GROUP BY session_id)
    SELECT {columns} FROM v"""


DURATION = """WITH e AS (SELECT user_id AS session_id, event_id, event_type, date_part('minute', ts) * 60 + date_part('second', ts) AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT session_id, count(*)::BIGINT AS utterance_count, (max(s) - min(s))::DOUBLE AS duration_seconds, count(*) FILTER (WHERE prev <> event_type)::BIGINT AS role_transition_count FROM e GROUP BY session_id"""
NORMALIZE = f"SELECT doc_id, {normal('text')} AS normal FROM documents"
TOKENS = rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_unique, array_to_string(t[1:20], ' ') AS head, n_words FROM (SELECT doc_id, {tokens('text')} AS t, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::BIGINT AS n_words FROM documents)"""
OBJECTIVES = f"""o0 AS (SELECT item_id, {tokens('text')} AS t FROM benchmark), o1 AS (SELECT item_id, t, list_filter(t, lambda x: NOT list_contains({listed(STOPWORDS)}, x)) AS k FROM o0), objectives AS (SELECT item_id AS objective_id, CASE WHEN len(k) > 0 THEN k ELSE t END AS obj, len(k)::BIGINT AS n_kept FROM o1)"""
STOPWORDS_SQL = f"SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE t END, ' ') AS kept, len(k)::BIGINT AS n_kept FROM (SELECT doc_id, t, list_filter(t, lambda x: NOT list_contains({listed(STOPWORDS)}, x)) AS k FROM (SELECT doc_id, {tokens('text')} AS t FROM documents))"
CLOCK = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('microsecond', ts) / 1000) / 1000, 6) END AS seconds FROM events"


def phrase(words) -> str:
    return "(" + " OR ".join(f"contains(hay, {quote(f' {w} ')})" for w in words) + ")"


LINES = f"""l0 AS (SELECT conv_id AS session_id, turn, {ROLE} AS role, {normal('text')} AS content FROM conversations),
l1 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, role, content) - 1 AS ord, {tokens('content')} AS toks FROM l0),
l2 AS (SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS hay FROM l1),
lines AS (SELECT session_id, ord, role, content, toks, hay, content <> '' AS ne, CASE WHEN content <> '' THEN role || ': ' || content ELSE '' END AS rendered,
  contains(content, '?') OR coalesce(list_contains({listed(QUESTION_STARTERS)}, toks[1]), false) AS q, {phrase(LEX.feedback)} AS fb, {phrase(LEX.correction)} AS co, {phrase(LEX.reasoning)} AS re, {phrase(LEX.uncertainty)} AS un FROM l2)"""


def lines(rest: str) -> str:
    return f"WITH {LINES} {rest}"


SCORED = f"""{LINES}, {OBJECTIVES},
resp AS (SELECT DISTINCT session_id, objective_id FROM (SELECT conv_id AS session_id, unnest([conv_id % items, (conv_id + 7) % items]) AS objective_id FROM conversations, (SELECT count(*) AS items FROM benchmark))),
s0 AS (SELECT l.*, r.objective_id, o.obj, list_distinct(o.obj) AS uniq FROM lines l JOIN resp r USING (session_id) JOIN objectives o USING (objective_id)),
s AS (SELECT *, CASE WHEN len(toks) = 0 OR len(obj) = 0 THEN 0::DOUBLE ELSE 0.8::DOUBLE * len(list_filter(uniq, lambda x: list_contains(toks, x))) / len(uniq)
  + 0.2::DOUBLE * list_sum(list_transform(uniq, lambda x: least(len(list_filter(toks, lambda y: y = x)), len(list_filter(obj, lambda y: y = x))))) / len(obj) END AS ovl FROM s0),
anchors AS (SELECT session_id, objective_id, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY ovl DESC, ord) AS rank FROM s WHERE ovl > 0) WHERE rank <= {K}),
near AS (SELECT s.session_id, s.objective_id, s.ord, min(a.rank * 3 + CASE s.ord - a.ord WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END)::BIGINT AS priority FROM anchors a JOIN s ON a.session_id = s.session_id AND a.objective_id = s.objective_id AND abs(s.ord - a.ord) <= 1 GROUP BY ALL)"""


def scored(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{SCORED} {rest}"


_PAIRED = "unnest([conv_id % items, (conv_id + 7) % items]) AS objective_id FROM conversations, (SELECT count(*) AS items FROM benchmark)"
assert _PAIRED in SCORED
#: The same over every conversation with every item of benchmark.
SCORED_ALL = SCORED.replace(_PAIRED, "item_id AS objective_id FROM conversations, benchmark")


def scored_all(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{SCORED_ALL} {rest}"


def greedy(items: str, budget: int, separator: int, name: str) -> str:
    return f""", items AS ({items}), g AS (
  SELECT DISTINCT session_id, objective_id, 0::BIGINT AS rn, 0::BIGINT AS used, []::STRUCT(ord BIGINT, text VARCHAR)[] AS sel, NULL::VARCHAR AS done FROM items
  UNION ALL SELECT g.session_id, g.objective_id, i.rn,
    CASE WHEN take THEN used + cost ELSE used END, CASE WHEN take THEN list_append(sel, {{'ord': i.ord, 'text': i.text}}) ELSE sel END,
    CASE WHEN done IS NULL AND i.text <> '' AND NOT take AND len(sel) = 0 THEN substr(i.text, 1, {budget}) ELSE done END
  FROM (SELECT g.*, i.ord AS io, i.text AS it, i.rn AS irn, length(i.text) + CASE WHEN len(sel) > 0 THEN {separator} ELSE 0 END AS cost, done IS NULL AND i.text <> '' AND used + length(i.text) + CASE WHEN len(sel) > 0 THEN {separator} ELSE 0 END <= {budget} AS take FROM g JOIN items i ON g.session_id = i.session_id AND g.objective_id = i.objective_id AND i.rn = g.rn + 1) g
  JOIN items i ON i.session_id = g.session_id AND i.objective_id = g.objective_id AND i.rn = g.irn)
SELECT session_id, objective_id, coalesce({name}, '') AS {name} FROM (SELECT DISTINCT session_id, objective_id FROM s) LEFT JOIN (SELECT session_id, objective_id, coalesce(done, array_to_string(list_transform(list_sort(sel), lambda x: x.text), chr(10))) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY rn DESC) AS z FROM g) WHERE z = 1) USING (session_id, objective_id)"""


def chosen(items: str, budget: int, separator: int, name: str) -> str:
    """The same as a relation NAME_t, whose helpers have names of their own."""
    out = _as(greedy(items, budget, separator, name), f"{name}_t")
    return re.sub(r"\bg\b", f"g_{name}", re.sub(r"\bitems\b", f"items_{name}", out))


def _as(text: str, name: str, start: str = "\nSELECT ") -> str:
    """Relations and a last SELECT as relations alone, the last one called name."""
    before, last = text.rsplit(start, 1)
    return f"{before}, {name} AS (SELECT {start.split('SELECT ', 1)[1]}{last})"


CONTEXT_ITEMS = "SELECT session_id, objective_id, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY priority, ord) AS rn, ord, rendered AS text FROM near JOIN s USING (session_id, objective_id, ord)"
WINDOW_ITEMS = "SELECT session_id, objective_id, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY score DESC, start, text) AS rn, start AS ord, text FROM win"


def role_items(role: str) -> str:
    return f"SELECT session_id, objective_id, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY rank, ord) AS rn, ord, rendered AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY ovl DESC, ord) AS rank FROM s WHERE ovl > 0 AND role = '{role}') WHERE rank <= {K}"


def _chunks(x: str) -> str:
    b = BUDGETS.edges
    return f"CASE WHEN length({x}) > {b} AND substr({x}, {b}, 1) = chr(10) THEN substr({x}, 1, {b - 1}) ELSE substr({x}, 1, {b}) END"


EDGES = f""", e AS (SELECT *, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY ord) AS a, row_number() OVER (PARTITION BY session_id, objective_id ORDER BY ord DESC) AS z FROM s WHERE ne),
j AS (SELECT session_id, objective_id, coalesce(string_agg(rendered, chr(10) ORDER BY ord) FILTER (WHERE a <= {BUDGETS.edge_lines}), '') AS o, coalesce(string_agg(rendered, chr(10) ORDER BY ord) FILTER (WHERE z <= {BUDGETS.edge_lines}), '') AS c FROM e GROUP BY ALL)
SELECT session_id, objective_id, coalesce({_chunks('o')}, '') AS opening, coalesce({_chunks('c')}, '') AS closing FROM (SELECT DISTINCT session_id, objective_id FROM s) LEFT JOIN j USING (session_id, objective_id)"""


def windows(kind: str) -> str:
    start, stop = ("a.role = 'tutor' AND a.q", "b.role = 'student' AND b.ne") if kind == "qa" else ("a.role = 'student' AND a.ne", "b.role = 'tutor' AND b.ne AND (b.fb OR b.co)")
    return f""", pairs AS (SELECT a.session_id, a.objective_id, a.ord AS start, b.ord AS stop, a.ovl + b.ovl AS score, a.rendered || chr(10) || b.rendered AS text, row_number() OVER (PARTITION BY a.session_id, a.objective_id, a.ord ORDER BY b.ord) AS z FROM s a JOIN s b ON a.session_id = b.session_id AND a.objective_id = b.objective_id AND b.ord BETWEEN a.ord + 1 AND a.ord + {BUDGETS.max_gap} WHERE {start} AND {stop}), win AS (SELECT * EXCLUDE z FROM pairs WHERE z = 1)"""


def windows_named(kind: str) -> str:
    return re.sub(r"\bwin\b", f"win_{kind}", re.sub(r"\bpairs\b", f"pairs_{kind}", windows(kind)))


def role_texts() -> str:
    parts = "".join(chosen(role_items(r), BUDGETS.role, 1, f"{r}_relevant") for r in ("tutor", "student"))
    return parts + " SELECT * FROM tutor_relevant_t JOIN student_relevant_t USING (session_id, objective_id)"


def response_texts() -> str:
    parts = chosen(CONTEXT_ITEMS, BUDGETS.context, 1, "objective_context") + "".join(chosen(role_items(r), BUDGETS.role, 1, f"{r}_relevant") for r in ("tutor", "student"))
    for kind in ("qa", "feedback"):
        parts += windows_named(kind) + chosen(WINDOW_ITEMS.replace("FROM win", f"FROM win_{kind}"), BUDGETS.window, 2, f"{kind}_text")
    parts += _as(EDGES, "edges_t")
    joins = "".join(f" JOIN {n}_t USING (session_id, objective_id)" for n in ("objective_context", "tutor_relevant", "student_relevant", "qa_text", "feedback_text", "edges"))
    return parts + f" SELECT resp.session_id, resp.objective_id, b.text AS learning_objective, full_text, tutor_text, student_text, objective_context, tutor_relevant, student_relevant, qa_text, feedback_text, opening, closing FROM resp JOIN benchmark b ON b.item_id = resp.objective_id JOIN ({views('session_id, full_text, tutor_text, student_text')}) USING (session_id){joins}"


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


DENSE_MATCH = f""", m AS (SELECT *, max(ord) OVER (PARTITION BY session_id, objective_id) AS n1 FROM s),
mm AS (SELECT *, CASE WHEN ovl > 0 THEN CASE WHEN n1 = 0 THEN 0 ELSE ord::DOUBLE / n1 END END AS place FROM m)
SELECT session_id, objective_id, len(any_value(obj))::DOUBLE AS objective_token_count, len(any_value(uniq))::DOUBLE AS objective_unique_token_count,
  len(list_filter(any_value(uniq), lambda x: list_contains(flatten(list(toks)), x)))::DOUBLE AS matched_objective_unique_count, count(*) FILTER (WHERE ovl > 0)::DOUBLE AS relevant_line_count,
  {r6('coalesce(max(ovl), 0)')} AS max_line_overlap, {r6('coalesce(avg(ovl) FILTER (WHERE ovl > 0), 0)')} AS mean_positive_line_overlap,
  {r6('coalesce(min(place), 0)')} AS first_match_position, {r6('coalesce(max(place), 0)')} AS last_match_position, {r6('coalesce(avg(place), 0)')} AS mean_match_position,
  {ratio('len(list_filter(any_value(uniq), lambda x: list_contains(flatten(list(toks)), x)))', 'len(any_value(uniq))')} AS objective_coverage, {ratio('count(*) FILTER (WHERE ovl > 0)', 'count(*) FILTER (WHERE ne)')} AS relevant_line_ratio
FROM mm GROUP BY session_id, objective_id"""


def _count(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


_SHARES = {f"{r}_ratio": (_count(f"role = '{r}'"), "count(*)") for r in ("tutor", "student", "background")} | {
    "other_role_ratio": (_count("role NOT IN ('tutor', 'student', 'background')"), "count(*)"),
    "unclear_line_ratio": (_count("unclear > 0"), _count("ne")),
    "tutor_char_ratio": ("coalesce(sum(len) FILTER (WHERE role = 'tutor'), 0)", "sum(len)"),
    "student_char_ratio": ("coalesce(sum(len) FILTER (WHERE role = 'student'), 0)", "sum(len)"),
    "tutor_question_ratio": (_count("role = 'tutor' AND q"), _count("role = 'tutor'")),
    "student_question_ratio": (_count("role = 'student' AND q"), _count("role = 'student'")),
    "tutor_feedback_ratio": (_count("role = 'tutor' AND fb"), _count("role = 'tutor'")),
    "tutor_correction_ratio": (_count("role = 'tutor' AND co"), _count("role = 'tutor'")),
    "role_transition_ratio": (_count("prev <> role"), "count(*) - 1"),
}
DENSE_VOLUME = rf""", v AS (SELECT *, length(content) AS len, len(regexp_extract_all(content, '(?i)\[\s*unclear\s*\]')) AS unclear, lag(role) OVER (PARTITION BY session_id ORDER BY ord) AS prev FROM lines)
SELECT session_id, count(*)::DOUBLE AS utterance_count, {_count('ne')}::DOUBLE AS nonempty_utterance_count, {', '.join(f"{_count(f"role = '{r}'")}::DOUBLE AS {r}_count" for r in ('tutor', 'student', 'background'))},
  {_count("role NOT IN ('tutor', 'student', 'background')")}::DOUBLE AS other_role_count, {_count('prev <> role')}::DOUBLE AS role_transition_count, sum(unclear)::DOUBLE AS unclear_occurrence_count, {_count('unclear > 0')}::DOUBLE AS unclear_line_count,
  sum(len)::DOUBLE AS total_char_count, sum(len(toks))::DOUBLE AS total_token_count, {r6('avg(len)')} AS mean_line_chars, {r6('median(len)')} AS median_line_chars, max(len)::DOUBLE AS max_line_chars, 0::DOUBLE AS duration_seconds, 0::DOUBLE AS utterances_per_minute,
  {_count("role = 'tutor' AND q")}::DOUBLE AS tutor_question_count, {_count("role = 'student' AND q")}::DOUBLE AS student_question_count, {_count("role = 'tutor' AND fb")}::DOUBLE AS tutor_feedback_count, {_count("role = 'tutor' AND co")}::DOUBLE AS tutor_correction_count,
  {', '.join(f'{ratio(a, b)} AS {n}' for n, (a, b) in _SHARES.items())} FROM v GROUP BY session_id"""


def dense_segments(deltas: bool = False) -> str:
    parts, out = [], []
    names = ("early", "mid", "late")
    for i, name in enumerate(names, 1):
        st, tu = f"t = {i} AND role = 'student'", f"t = {i} AND role = 'tutor'"
        share = lambda cond, of: f"CASE WHEN {_count(of)} = 0 THEN 0 ELSE {_count(cond)}::DOUBLE / {_count(of)} END"
        parts += [
            f"{share(st, f't = {i}')} AS {name}_student_share", f"coalesce(avg(length(content)) FILTER (WHERE {st}), 0) AS {name}_student_mean_chars",
            f"{share(st + ' AND re', st)} AS {name}_student_reasoning_ratio", f"{share(st + ' AND un', st)} AS {name}_student_uncertainty_ratio",
            f"{share(tu + ' AND q', tu)} AS {name}_tutor_question_ratio", f"{share(tu + ' AND fb', tu)} AS {name}_tutor_feedback_ratio", f"{share(tu + ' AND co', tu)} AS {name}_tutor_correction_ratio",
        ]
    metrics = [p.rsplit(" AS early_", 1)[1] for p in parts[:7]]
    if deltas:
        out = [f"{r6(f'{n}_{m} - early_{m}')} AS {m}_{n}_minus_early" for m in metrics for n in names[1:]]
    else:
        out = [f"{r6(f'{n}_{m}')} AS {n}_{m}" for n in names for m in metrics]
    return f", t AS (SELECT *, ntile(3) OVER (PARTITION BY session_id ORDER BY ord) AS t FROM lines), g AS (SELECT session_id, {', '.join(parts)} FROM t GROUP BY session_id) SELECT session_id, {', '.join(out)} FROM g"


def dense_all() -> str:
    seg, delta = (dense_segments(d).rsplit(" SELECT session_id, ", 1) for d in (False, True))
    parts = _as(DENSE_MATCH, "dm") + _as(DENSE_VOLUME, "dv") + f"{seg[0]}, ds AS (SELECT session_id, {seg[1]}), dd AS (SELECT session_id, {delta[1]})" + chosen(CONTEXT_ITEMS, BUDGETS.context, 1, "objective_context")
    counts = "".join(windows_named(k) + f", n_{k} AS (SELECT session_id, objective_id, count(*)::DOUBLE AS n FROM win_{k} GROUP BY ALL)" for k in ("qa", "feedback"))
    return parts + counts + f""" SELECT dm.*, {ratio('length(objective_context)', str(BUDGETS.context))} AS selected_context_char_ratio, dv.* EXCLUDE session_id, ds.* EXCLUDE session_id, dd.* EXCLUDE session_id, coalesce(n_qa.n, 0) AS qa_window_count, coalesce(n_feedback.n, 0) AS feedback_window_count
FROM dm JOIN objective_context_t USING (session_id, objective_id) JOIN dv USING (session_id) JOIN ds USING (session_id) JOIN dd USING (session_id) LEFT JOIN n_qa USING (session_id, objective_id) LEFT JOIN n_feedback USING (session_id, objective_id)"""


_LABELS = {
    "tutor": (("hint", phrase(LEX.hint)), ("question", "q"), ("direct_explanation", phrase(LEX.explanation)), ("correction", "co"), ("feedback", "fb")),
    "student": (("reasoning", phrase(LEX.action_reasoning)), ("uncertainty", phrase(LEX.action_uncertainty)), ("confidence", phrase(LEX.confidence))),
}
_PICKED = " ".join(f"WHEN role = '{r}' THEN list_filter([{', '.join(f'CASE WHEN {c} THEN {quote(n)} END' for n, c in ls)}], lambda x: x IS NOT NULL)" for r, ls in _LABELS.items())
ACTIONS = f""", a0 AS (SELECT *, CASE {_PICKED} ELSE [] END AS found, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS idx FROM lines WHERE ne),
a AS (SELECT session_id, idx, role, toks, CASE WHEN len(found) > 0 THEN found ELSE ['other'] END AS actions FROM a0)"""
_TUTOR = "['hint', 'question', 'direct_explanation', 'correction', 'feedback']"
GRAPH_COUNTS = f""" SELECT session_id, {_count("list_contains(actions, 'hint')")}::BIGINT AS hint_count, {_count("list_has_any(actions, ['hint', 'question', 'correction'])")}::BIGINT AS tutor_intervention_count,
  len(list_filter(list_distinct(flatten(list(actions))), lambda x: list_contains({_TUTOR}, x)))::BIGINT AS strategy_diversity FROM a GROUP BY session_id"""


def _run(flag: str, table: str = "a") -> str:
    return f"(SELECT session_id, max(n)::BIGINT AS n FROM (SELECT session_id, island, {_count('f')} AS n FROM (SELECT session_id, {flag} AS f, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY idx) AS island FROM {table}) GROUP BY ALL) GROUP BY session_id)"


def _flip(flag: str, table: str = "a") -> str:
    return f"(SELECT session_id, {_count('f <> g')}::BIGINT AS n FROM (SELECT session_id, {flag} AS f, lag({flag}) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM {table}) GROUP BY session_id)"


_DEPTH = "list_has_any(actions, ['hint', 'question'])"
GRAPH_RUNS = f" SELECT h.session_id, h.n AS hint_depth, c.n AS correction_chain_length FROM {_run(_DEPTH)} h JOIN {_run("list_contains(actions, 'correction')")} c USING (session_id)"
EVENT_RUNS = "WITH e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type FROM events) SELECT r.session_id, r.n AS longest_clicks, f.n AS n_flips FROM " + _run("event_type = 'click'", "e") + " r JOIN " + _flip("event_type = 'click'", "e") + " f USING (session_id)"
GRAPH_EDGES = f""", p AS (SELECT session_id, lag(actions) OVER (PARTITION BY session_id ORDER BY idx) AS prev, actions FROM a), e0 AS (SELECT session_id, unnest(prev) AS src, actions FROM p WHERE prev IS NOT NULL),
e AS (SELECT DISTINCT session_id, src, dst FROM (SELECT session_id, src, unnest(actions) AS dst FROM e0) WHERE src <> dst), d AS (SELECT session_id, src, count(*) AS deg FROM e GROUP BY ALL), x AS (SELECT session_id, sum(deg) AS edges, max(deg) AS top FROM d GROUP BY session_id),
n AS (SELECT session_id, count(DISTINCT act) AS nodes FROM (SELECT session_id, unnest(actions) AS act FROM a) GROUP BY session_id)
SELECT session_id, nodes::BIGINT AS node_count, coalesce(edges, 0)::BIGINT AS edge_count, {ratio('coalesce(edges, 0)', 'nodes * (nodes - 1)')} AS density, {ratio('coalesce(edges, 0)', 'nodes')} AS mean_node_degree, coalesce(top, 0)::DOUBLE AS max_node_degree FROM n LEFT JOIN x USING (session_id)"""
GRAPH_PERSISTENCE = f""", w AS (SELECT *, coalesce(max(CASE WHEN list_contains(actions, 'feedback') OR list_contains(actions, 'correction') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS answered,
  coalesce(max(CASE WHEN list_contains(actions, 'correction') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS after FROM a)
SELECT session_id, {_count("list_contains(actions, 'uncertainty') AND after = 1")}::BIGINT AS misconception_persistence, {_count("list_contains(actions, 'uncertainty') AND answered = 0")}::BIGINT AS unresolved_misconception_count FROM w GROUP BY session_id"""


def _change(name: str) -> str:
    share = lambda t: f"CASE WHEN {_count(f't = {t}')} = 0 THEN 0 ELSE {_count(f"t = {t} AND list_contains(actions, '{name}')")}::DOUBLE / {_count(f't = {t}')} END"
    return f"CASE WHEN count(*) < 2 THEN 0 ELSE {share(3)} - {share(1)} END"


GRAPH_THIRDS = f""", t AS (SELECT *, ntile(3) OVER (PARTITION BY session_id ORDER BY idx) AS t FROM a WHERE role = 'student'), c AS (SELECT session_id, {_change('reasoning')} AS r, {_change('confidence')} AS k FROM t GROUP BY session_id)
SELECT session_id, {r6('coalesce(r, 0)')} AS reasoning_improvement_score, {r6('coalesce(k, 0)')} AS confidence_change FROM (SELECT DISTINCT session_id FROM a) LEFT JOIN c USING (session_id)"""

CONCEPTS = """, ct AS (SELECT session_id, objective_id, count(*) FILTER (WHERE f <> g)::BIGINT AS concept_transition_count FROM (SELECT l.session_id, r.objective_id, list_has_any(l.toks, o.k) AS f,
  lag(list_has_any(l.toks, o.k)) OVER (PARTITION BY l.session_id, r.objective_id ORDER BY l.ord) AS g FROM lines l JOIN resp r USING (session_id) JOIN o1 o ON o.item_id = r.objective_id WHERE ne) GROUP BY ALL)"""


def graph_all() -> str:
    names = ("hint_count", "hint_depth", "strategy_diversity", "correction_chain_length", "tutor_intervention_count", "concept_transition_count", "reasoning_improvement_score", "confidence_change", "misconception_persistence", "unresolved_misconception_count", "density", "mean_node_degree", "max_node_degree", "node_count")
    parts = ACTIONS + f", gc AS ({GRAPH_COUNTS}), gr AS ({GRAPH_RUNS})" + _as(GRAPH_PERSISTENCE, "gp") + _as(GRAPH_THIRDS, "gt") + _as(GRAPH_EDGES, "ge") + CONCEPTS
    joins = "".join(f" LEFT JOIN {t} USING (session_id)" for t in ("gc", "gr", "gp", "gt", "ge"))
    return parts + f" SELECT resp.session_id, resp.objective_id, {', '.join(f'coalesce({n}, 0)::DOUBLE AS graph_{n}' for n in names)} FROM resp{joins} LEFT JOIN ct USING (session_id, objective_id)"


PROFILE = "SELECT column_name, n_rows, n_missing FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name, n::BIGINT AS n_rows, unnest(m)::BIGINT AS n_missing FROM (SELECT count(*) AS n, [count(*) - count(event_id), count(*) - count(ts), count(*) - count(user_id), count(*) - count(event_type), count(*) - count(value), count(*) - count(props)] AS m FROM events))"

PROBS = "WITH p AS (SELECT l_orderkey AS session, p_brand AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 0.05::DOUBLE + l_discount * 9 AS p1, l_tax * 10 + 0.1::DOUBLE AS p2, l_quantity / 51 AS p3 FROM lineitem JOIN part ON l_partkey = p_partkey)"
FOLDS = PROBS + """, gr AS (SELECT grp, sum(y)::BIGINT AS pos, count(*)::BIGINT AS size FROM p GROUP BY grp), oi AS (SELECT *, row_number() OVER (ORDER BY pos DESC, size DESC, md5(grp || '0')) - 1 AS i FROM gr),
folds AS (SELECT grp, pos, size, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INTEGER AS fold FROM oi)"""
_E = "2.220446049250313e-16::DOUBLE"


def log_loss(p: str) -> str:
    q = f"least(greatest({p}, {_E}), 1 - {_E})"
    return f"avg(-(y * ln({q}) + (1 - y) * ln(1 - {q})))"


AUC = " , b AS (SELECT grp, p3, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY ALL), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY p3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT grp, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) END, 6) AS auc FROM c GROUP BY grp"


def platt(p: str, a: float, b: float) -> str:
    q = f"least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
    return f"1 / (1 + exp(-({a}::DOUBLE * (ln({q}) - ln(1 - {q})) + {b}::DOUBLE)))"


BLEND = "least(greatest(p1 * 0.25::DOUBLE + p2 * 0.25::DOUBLE + p3 * 0.5::DOUBLE, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
_LOSSES = ", ".join(f"{log_loss(x)} AS {n}" for n, x in (("l0", "0.33::DOUBLE"), ("l1", "p1"), ("l2", "p2"), ("l3", "p3"), ("le", BLEND)))
GATE = FOLDS + f", f AS (SELECT fold, {_LOSSES} FROM p JOIN folds USING (grp) GROUP BY fold) SELECT bool_and(le < least(l0, l1, l2, l3)) AS passed, arg_max(fold, le) AS worst_fold, round(max(le), 6) AS worst FROM f"
ABLATION = PROBS + f" SELECT grp, round(le - l3, 6) AS delta FROM (SELECT grp, {_LOSSES} FROM p GROUP BY grp)"

HASHED = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS t FROM documents), g AS (SELECT doc_id, unnest(t) AS g FROM t UNION ALL SELECT doc_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) FROM t WHERE len(t) > 1),
c AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 1024 AS bucket, count(*)::DOUBLE AS c FROM g GROUP BY ALL) SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c"""
_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"
GATHERED = f"WITH ob AS (SELECT label, arg_min(embedding, vec_id) AS objective FROM embeddings GROUP BY label), g AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS c, {_UNIT.format('objective')} AS o FROM embeddings JOIN ob USING (label))"
LLOYD = """WITH c AS (SELECT vec_id::INTEGER AS cluster, embedding AS centre FROM embeddings WHERE vec_id < 5),
d AS (SELECT e.vec_id, cluster, embedding, list_sum(list_transform(list_zip(embedding, centre), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM embeddings e, c),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS z FROM d) WHERE z = 1),
x AS (SELECT cluster, unnest(range(0, 64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM a)
SELECT cluster, dim, round(avg(x), 6) AS mean, count(*)::BIGINT AS n FROM x GROUP BY ALL"""


def _hashed(key: str, column: str, table: str, n: int, offset: int) -> str:
    return rf"""(WITH t AS (SELECT {key}, regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM {table}), g AS (SELECT {key}, unnest(t) AS g FROM t UNION ALL SELECT {key}, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) FROM t WHERE len(t) > 1),
c AS (SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT % {n} AS bucket, count(*)::DOUBLE AS c FROM g GROUP BY ALL) SELECT {key}, bucket + {offset} AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY {key})), 6) AS value FROM c)"""


def response_hashes(sizes: dict[str, int], objective_size: int) -> str:
    parts, offset = [], 0
    for name, n in sizes.items():
        parts.append(f"SELECT session_id, objective_id, bucket, value FROM resp JOIN {_hashed('session_id', name, 'vw', n, offset)} USING (session_id)")
        offset += n
    parts.append(f"SELECT session_id, objective_id, bucket, value FROM resp JOIN {_hashed('objective_id', 'objective', 'ob', objective_size, offset)} USING (objective_id)")
    resp = f"SELECT DISTINCT session_id, objective_id FROM (SELECT conv_id AS session_id, {_PAIRED})"
    return f"WITH resp AS ({resp}), vw AS ({views('session_id, full_text, tutor_text, student_text')}), ob AS (SELECT item_id AS objective_id, text AS objective FROM benchmark) " + " UNION ALL ".join(parts)


def folds_of(group: str) -> str:
    """FOLDS over other groups."""
    return FOLDS.replace("p_brand AS grp", f"{group} AS grp")


SPLIT = ", sp AS (SELECT p.*, CASE WHEN fold = 0 THEN 'validation' WHEN session IN (SELECT session FROM p JOIN folds USING (grp) WHERE fold = 0) THEN 'purged' ELSE 'train' END AS split FROM p JOIN folds USING (grp))"
ISOLATION = FOLDS + SPLIT + " SELECT k AS key, (SELECT count(*) FROM (SELECT CASE k WHEN 'session' THEN session::VARCHAR ELSE grp END AS v FROM sp WHERE split <> 'purged' GROUP BY v HAVING count(DISTINCT split) > 1))::BIGINT AS n_shared, (SELECT count(*) FROM (SELECT CASE k WHEN 'session' THEN session::VARCHAR ELSE grp END AS v FROM sp GROUP BY v HAVING count(DISTINCT split = 'validation') > 1))::BIGINT AS n_before FROM (SELECT unnest(['session', 'grp']) AS k)"


def field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-1:' ELSE length({x}::VARCHAR) || ':' || {x} END"
