"""Every session with every objective: overlaps in numpy, and what is chosen by them.

A product has a row for each pair, so its cost is that of a pair. Sessions travel whole, with the tokens of
their lines, and objectives travel to every worker; overlaps are sums over the tokens that a line and an objective share. Texts
depend on the order in which lines (or windows) are chosen and not on the objective itself, so a session's
text is made once for each order that occurs and given to all objectives of that order. A worker holds at most
`CELLS` overlaps at once, or those of one session with one objective.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convolake.functions.lexicon import Budgets
from convolake.functions.text import finite, ratio
from convolake.operators import dense as D
from convolake.operators import evidence as V

CELLS = 1 << 19


class Objectives:
    """Ids and tokens of objectives, and for each token the objectives that hold it and how often."""

    def __init__(self, ids: pa.Array, tokens: list[list[str]]):
        self.ids, self.size = ids, np.array([len(t) for t in tokens], np.int64)
        self.unique = np.array([len(set(t)) for t in tokens], np.int64)
        words: dict[str, int] = {}
        entries = np.array([(words.setdefault(w, len(words)), o) for o, t in enumerate(tokens) for w in t], np.int64).reshape(-1, 2)
        pairs, self.count = np.unique(entries[:, 0] * max(len(tokens), 1) + entries[:, 1], return_counts=True)
        self.word, self.objective = np.divmod(pairs, max(len(tokens), 1))
        self.words = pa.array(list(words), pa.string())

    def __len__(self) -> int:
        return len(self.size)

    def within(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of objectives lo:hi: where each word's begin, their objectives and counts."""
        own = (self.objective >= lo) & (self.objective < hi)
        return np.searchsorted(self.word[own], np.arange(len(self.words) + 1)), self.objective[own] - lo, self.count[own]


def met(owner: np.ndarray, word: np.ndarray, n: int, entries: tuple, width: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words that each of n owners shares with each objective, and their common occurrences."""
    begin, objective, count = entries
    pairs, often = np.unique(owner * max(n_words, 1) + word, return_counts=True)
    owner, word = np.divmod(pairs, max(n_words, 1))
    many = begin[word + 1] - begin[word]
    at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    cell = np.repeat(owner, many) * width + objective[at]
    both = np.bincount(cell, np.minimum(np.repeat(often, many), count[at]), n * width)
    return np.bincount(cell, minlength=n * width).reshape(n, width), both.reshape(n, width)


@dataclass
class Part:
    """Some sessions with some objectives: overlaps of lines (rows) with objectives (columns)."""

    rows: pa.RecordBatch  #: one a session
    first: np.ndarray  #: where each session's lines begin, and the end
    lo: int  #: the first objective
    overlap: np.ndarray
    shared: Callable[[], np.ndarray]  #: distinct objective tokens in each session

    @property
    def session(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows.num_rows), np.diff(self.first))

    def ranked(self, values: np.ndarray, session: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, row, rank from 0) of the cells, groups being sessions by objectives: the largest value first, then the earlier row."""
        row, col = np.divmod(cells, values.shape[1])
        group = session[row] * values.shape[1] + col
        order = np.lexsort((-values.ravel()[cells], group))
        group, row = group[order], row[order]
        return group, row, np.arange(len(group)) - np.searchsorted(group, group)

    def anchors(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, position in the session, rank from 0) of each group's k best lines of positive overlap."""
        session = self.session
        group, row, rank = self.ranked(self.overlap, session, np.flatnonzero(self.overlap > 0))
        keep = rank < k
        return group[keep], (row - self.first[session[row]])[keep], rank[keep]


Emit = Callable[[Part, Objectives], pa.RecordBatch]


def over(sessions: DataFrame, objectives: DataFrame, emit: Emit, fields: str, cells: int = CELLS) -> DataFrame:
    """What emit makes of parts of the product; sessions: session_id, toks (of each line in order), more; objectives: objective_id, objective."""
    kind = objectives.schema["objective_id"].dataType
    sent = objectives.where(F.col("objective_id").isNotNull()).select("objective_id", V.objective_tokens(F.col("objective")).alias("toks")).collect()
    found = Objectives(pa.array([r[0] for r in sent], to_arrow_schema(T.StructType([T.StructField("i", kind)])).field(0).type), [list(r[1]) for r in sent])
    known = {f.name: f.dataType for f in sessions.schema.fields} | {"objective_id": kind}
    schema = T.StructType()
    for field in fields.split(", "):
        name, _, of = field.partition(" ")
        schema.add(name, T._parse_datatype_string(of.replace("KEY", kind.simpleString())) if of else known[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = np.asarray(pc.list_value_length(batch["toks"]).fill_null(0), np.int64)
            lo = 0
            while lo < batch.num_rows and len(found):
                total = np.cumsum(lines[lo:])
                hi = lo + max(1, int(np.searchsorted(total, cells // len(found), side="right")))
                rows = batch.slice(lo, hi - lo)
                first = np.concatenate([[0], np.cumsum(lines[lo:hi])])
                toks = rows["toks"].flatten()
                owner = np.repeat(np.arange(len(toks)), np.asarray(pc.list_value_length(toks).fill_null(0)))
                word = pc.index_in(toks.flatten(), value_set=found.words)
                good = np.asarray(word.is_valid())
                owner, word = owner[good], np.asarray(word.fill_null(0), np.int64)[good]
                of = np.repeat(np.arange(hi - lo), lines[lo:hi])
                step = max(1, cells // max(int(first[-1]), 1))
                for a in range(0, len(found), step):
                    b = min(a + step, len(found))
                    entries, n = found.within(a, b), len(found.words)
                    unique, both = met(owner, word, int(first[-1]), entries, b - a, n)
                    overlap = 0.8 * unique / np.maximum(found.unique[a:b], 1) + 0.2 * both / np.maximum(found.size[a:b], 1)
                    yield emit(Part(rows, first, a, overlap, lambda e=entries, w=b - a, n=n: met(of[owner], word, len(rows), e, w, n)[0]), found)
                lo = hi

    return sessions.mapInArrow(run, schema)


def sessions(lines: DataFrame, *more: str, **items) -> DataFrame:
    """One row a session: tokens, and more columns, of its lines in order; items are more aggregates."""
    inside = F.array_sort(F.collect_list(F.struct("ord", "toks", *more)))
    d = lines.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(inside.alias("_l"), *[v.alias(k) for k, v in items.items()])
    return d.select("session_id", *[F.col("_l").getField(c).alias(c) for c in ("toks", *more)], *items)


# ---- rows of scores, anchors, windows and features ----------------------------------------------


def overlaps(lines: DataFrame, objectives: DataFrame) -> DataFrame:
    """The overlap of every line with every objective."""

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        n, width = p.overlap.shape
        session, ordinal = p.session, np.arange(n) - p.first[p.session]
        ids = p.rows["session_id"].take(pa.array(np.repeat(session, width)))
        return pa.RecordBatch.from_arrays([ids, o.ids.take(pa.array(np.tile(np.arange(width), n) + p.lo)), pa.array(np.repeat(ordinal, width)), pa.array(p.overlap.ravel())], names=["session_id", "objective_id", "ord", "ovl"])

    return over(sessions(lines), objectives, emit, "session_id, objective_id, ord long, ovl double")


def anchors(lines: DataFrame, objectives: DataFrame, k: int) -> DataFrame:
    """The k best lines of positive overlap of each response, ties to the earlier line."""

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        group, at, rank = p.anchors(k)
        session, objective = np.divmod(group, p.overlap.shape[1])
        return pa.RecordBatch.from_arrays([p.rows["session_id"].take(pa.array(session)), o.ids.take(pa.array(objective + p.lo)), pa.array(at), pa.array(rank + 1)], names=["session_id", "objective_id", "ord", "rank"])

    return over(sessions(lines), objectives, emit, "session_id, objective_id, ord long, rank long")


def with_windows(lines: DataFrame, gap: int, kind: str) -> DataFrame:
    """One row a session: tokens, and its windows (start, stop, text), which depend on no objective."""
    own = V.window_ends(lines, gap, kind, ("session_id",))
    item = F.struct(F.col("ord").alias("start"), F.col("hit.ord").alias("stop"), V.window_text().alias("text"))
    return sessions(own, wins=F.array_sort(F.collect_list(F.when(F.col("starts") & F.col("hit").isNotNull(), item))))


def _windows(p: Part) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Session and scores of each window, and the windows."""
    wins = p.rows["wins"].flatten()
    of = np.repeat(np.arange(p.rows.num_rows), np.asarray(pc.list_value_length(p.rows["wins"])))
    start, stop = (np.asarray(wins.field(i), np.int64) + p.first[of] for i in (0, 1))
    return of, p.overlap[start] + p.overlap[stop], wins


def windows(lines: DataFrame, objectives: DataFrame, gap: int, kind: str) -> DataFrame:
    """The windows of each session with their scores for each objective."""

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        of, scores, wins = _windows(p)
        n, width = scores.shape
        ids = o.ids.take(pa.array(np.tile(np.arange(width), n) + p.lo))
        at = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.StructArray.from_arrays([ids, pa.array(scores.ravel())], names=["objective_id", "score"]))
        return pa.RecordBatch.from_arrays([p.rows["session_id"].take(pa.array(of)), *wins.flatten(), at], names=["session_id", "start", "stop", "text", "at"])

    d = over(with_windows(lines, gap, kind), objectives, emit, "session_id, start int, stop int, text string, at array<struct<objective_id:KEY,score:double>>")
    d = d.select("session_id", "start", "stop", "text", F.explode("at").alias("at"))
    return d.select("session_id", "at.objective_id", "start", "stop", "at.score", "text")


def _matches(p: Part, o: Objectives) -> dict[str, np.ndarray]:
    """The features of `dense.match_features` of sessions (rows) and objectives (columns)."""
    hit, begin, lines = p.overlap > 0, p.first[:-1], np.diff(p.first)
    width = p.overlap.shape[1]
    places = ((np.arange(len(p.overlap)) - p.first[p.session]) / np.maximum(lines - 1, 1)[p.session])[:, None]
    n = np.add.reduceat(hit, begin, 0, dtype=np.int64)
    mean = lambda x: np.add.reduceat(np.where(hit, x, 0.0), begin, 0) / np.maximum(n, 1)
    shared = p.shared().astype(float)
    unique = o.unique[p.lo : p.lo + width]
    nonempty = np.asarray(p.rows["n_nonempty"], np.int64)[:, None]
    whole = lambda x: np.broadcast_to(x.astype(float), n.shape)
    return {
        "objective_token_count": whole(o.size[p.lo : p.lo + width]),
        "objective_unique_token_count": whole(unique),
        "matched_objective_unique_count": shared,
        "relevant_line_count": n.astype(float),
        "max_line_overlap": np.maximum.reduceat(p.overlap, begin, 0),
        "mean_positive_line_overlap": mean(p.overlap),
        "first_match_position": np.where(n > 0, np.minimum.reduceat(np.where(hit, places, np.inf), begin, 0), 0.0),
        "last_match_position": np.maximum.reduceat(np.where(hit, places, 0.0), begin, 0),
        "mean_match_position": mean(places),
        "objective_coverage": shared / np.maximum(unique, 1),
        "relevant_line_ratio": n / np.maximum(nonempty, 1) * (nonempty > 0),
    }


#: Names of the features of a match, and those of them that are no counts.
MATCHES = ("objective_token_count", "objective_unique_token_count", "matched_objective_unique_count", "relevant_line_count", "max_line_overlap", "mean_positive_line_overlap", "first_match_position", "last_match_position", "mean_match_position", "objective_coverage", "relevant_line_ratio")
MEANS = MATCHES[4:]


def _members(p: Part, o: Objectives, features: bool) -> pa.StructArray:
    """Objective, and features where asked for, of each session by objective."""
    n, width = p.rows.num_rows, p.overlap.shape[1]
    ids = o.ids.take(pa.array(np.tile(np.arange(width), n) + p.lo))
    found = _matches(p, o) if features else {}
    return pa.StructArray.from_arrays([ids, *[pa.array(v.ravel()) for v in found.values()]], names=["objective_id", *found])


def match_features(lines: DataFrame, objectives: DataFrame) -> DataFrame:
    """`dense.match_features` of every session and objective."""

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        m = _members(p, o, True)
        ids = p.rows["session_id"].take(pa.array(np.repeat(np.arange(p.rows.num_rows), p.overlap.shape[1])))
        return pa.RecordBatch.from_arrays([ids, *m.flatten()], names=["session_id", "objective_id", *MATCHES])

    return over(sessions(lines, n_nonempty=F.count_if("ne")), objectives, emit, "session_id, objective_id, " + ", ".join(f"{m} double" for m in MATCHES))


# ---- texts, once for each order of lines or windows ---------------------------------------------


def orders(p: Part, group: np.ndarray, value: np.ndarray, members: pa.StructArray) -> pa.ListArray:
    """For each session the orders that occur, each with its members: array<struct<order, members>>.

    group, value: the values of each group (session by objective) in order.
    """
    groups = p.rows.num_rows * p.overlap.shape[1]
    size = np.bincount(group, minlength=groups)
    begin = np.cumsum(size) - size
    code = np.arange(groups) // p.overlap.shape[1]
    after, most = p.rows.num_rows, int(value.max(initial=0)) + 1
    active = np.arange(groups)
    for j in range(int(size.max(initial=0))):  # groups of one code agree on their session and on the first j values
        active = active[size[active] > j]
        found, inverse = np.unique(code[active] * most + value[begin[active] + j], return_inverse=True)
        code[active] = after + inverse
        after += len(found)
    order = np.lexsort((code, np.arange(groups) // p.overlap.shape[1]))
    new = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    one = order[new]
    length = size[one]
    at = np.repeat(begin[one] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    to32 = lambda x: pa.array(np.concatenate([[0], x]).astype(np.int32))
    chosen = pa.ListArray.from_arrays(to32(np.cumsum(length)), pa.array(value[at].astype(np.int32)))
    held = pa.ListArray.from_arrays(to32(np.append(new[1:], groups)), members.take(pa.array(order)))
    per = np.bincount(one // p.overlap.shape[1], minlength=p.rows.num_rows)
    return pa.ListArray.from_arrays(to32(np.cumsum(per)), pa.StructArray.from_arrays([chosen, held], names=["order", "members"]))


def spread(p: Part, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, position) of each group's anchors and their neighbours, as `evidence.neighbours` orders them."""
    group, at, rank = p.anchors(k)
    steps = np.array([0, *[x for d in range(1, radius + 1) for x in (-d, d)]])
    position = (at[:, None] + steps).ravel()
    priority = (rank[:, None] * len(steps) + np.arange(len(steps))).ravel()
    group = np.repeat(group, len(steps))
    inside = (position >= 0) & (position < np.diff(p.first)[group // p.overlap.shape[1]])
    group, position, priority = group[inside], position[inside], priority[inside]
    again = np.lexsort((priority, position, group))
    g, x = group[again], position[again]
    again = again[np.append(True, (np.diff(g) != 0) | (np.diff(x) != 0))[: len(again)]]
    again = again[np.lexsort((priority[again], group[again]))]
    return group[again], position[again]


def _kind(features: bool) -> str:
    return "orders array<struct<order:array<int>,members:array<struct<objective_id:KEY" + "".join(f",{m}:double" for m in MATCHES * features) + ">>>>"


def _opened(d: DataFrame, *columns) -> DataFrame:
    """A row for each member, beside columns made once for each order."""
    d = d.withColumn("o", F.explode("orders")).select("session_id", F.col("o.members").alias("members"), *columns)
    names = [c for c in d.columns if c not in ("session_id", "members")]
    return d.select("session_id", F.explode("members").alias("m"), *names).select("session_id", "m.*", *names)


def context(lines: DataFrame, objectives: DataFrame, b: Budgets, beside: DataFrame | None = None, once: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """objective_context of every session and objective; with beside, rows of sessions: its share of the budget, the features of its match and those rows."""
    of, features = sessions(lines, "rendered", n_nonempty=F.count_if("ne")), beside is not None
    items = [c for c in beside.columns if c != "session_id"] if features else []
    of = of.join(beside, "session_id") if features else of
    kept = ["session_id", "rendered", *items]

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[p.rows[c] for c in kept], orders(p, *spread(p, b.top_k, b.radius), _members(p, o, features))], names=[*kept, "orders"])

    text = F.transform("o.order", lambda i: F.struct(i.alias("ord"), F.get(F.col("rendered"), i).alias("text")))
    chosen = V.joined(V.greedy(text, b.context, 1))
    chosen = once(ratio(F.length(chosen), F.lit(b.context))).alias("selected_context_char_ratio") if features else chosen.alias("objective_context")
    return _opened(over(of, objectives, emit, ", ".join(kept) + ", " + _kind(features)), chosen, *items)


def dense_features(lines: DataFrame, objectives: DataFrame, b: Budgets = Budgets(), digits: int = 6) -> DataFrame:
    """`dense.dense_features` of every session and objective; what a session or an order of lines has alone is rounded there, once."""
    once = lambda x: F.round(finite(x), digits)
    session = D.session_features(lines, b)
    names = [c for c in session.columns if c != "session_id"]
    d = context(lines, objectives, b, session.select("session_id", *[once(F.col(c)).alias(c) for c in names]), once)
    return d.select(*V.RESPONSE, *MATCHES, "selected_context_char_ratio", *names)


def window_texts(lines: DataFrame, objectives: DataFrame, b: Budgets, kind: str, name: str = "windows_text") -> DataFrame:
    """The best windows within the budget of every session and objective."""

    def emit(p: Part, o: Objectives) -> pa.RecordBatch:
        of, scores, _ = _windows(p)
        group, row, _ = p.ranked(scores, of, np.arange(scores.size))
        begin = np.searchsorted(of, np.arange(p.rows.num_rows))
        return pa.RecordBatch.from_arrays([p.rows["session_id"], p.rows["wins"], orders(p, group, row - begin[of[row]], _members(p, o, False))], names=["session_id", "wins", "orders"])

    item = F.transform("o.order", lambda i: F.struct(F.get(F.col("wins"), i)["start"].alias("ord"), F.get(F.col("wins"), i)["text"].alias("text")))
    return _opened(over(with_windows(lines, b.max_gap, kind), objectives, emit, "session_id, wins, " + _kind(False)), V.joined(V.greedy(item, b.window, 2)).alias(name))
