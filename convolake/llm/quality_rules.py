"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule states the work a text costs it: the characters its patterns read, the words it hashes and
sorts, or one unit for a comparison of counts that exist. On a spread sample of about `sample_rows`
texts (by a hash of the row) one job averages that work and counts each rule's rejections, and the
rules run in the order of rejections per work, nested so that a document leaves at the first that
rejects it. Work is counted, not timed, so the order is the same in every run. The order changes what
is computed, never the verdict.

`quality_rules` returns counts of every row, so these are made before its cascade; `keep_good` only
decides, so the base rules and their counts are steps of the cascade like the others.

Repeated five-word windows are found within the row: window hashes are compared as a set first, and
only texts with a repeat sort them. Nothing is shuffled.

Defined results: null text, empty text and text without words have counts of 0 and fail the base
rules; repeated rows get equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import WORD, let

WINDOW = 5


def repeated_words(words: Column, *, least: int = 1 << 24) -> Column:
    """Words inside five-word windows that occur twice or more, the first occurrence included.

    Texts of `least` windows are sorted by hash and place apart, which is slower; up to there both fit one number.
    """

    def slowly(windows: Column) -> Column:
        """Places of repeated windows, whatever the hashes and the number of places."""
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == x["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        return let(pairs, repeats)

    def covered(windows: Column) -> Column:
        # hash and place in one number: sorting brings equal windows together, in the order of places
        coded = F.sort_array(F.transform(windows, lambda x, i: x.bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(i.cast("bigint"))))

        def repeats(s: Column) -> Column:
            def full(x: Column) -> Column:
                return F.get(windows, x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))

            def same(x: Column, i: Column) -> Column:
                before = F.when(i > 0, full(F.get(s, i - 1)) == full(x)).otherwise(False)
                after = F.when(i < F.size(s) - 1, full(F.get(s, i + 1)) == full(x)).otherwise(False)
                return before | after

            return F.sort_array(F.transform(F.filter(s, same), lambda x: x.bitwiseAND(F.lit((1 << 24) - 1))))

        def cover(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW).cast("bigint"), F.when(i < F.size(at) - 1, F.get(at, i + 1) - p).otherwise(F.lit(WINDOW).cast("bigint"))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)

        def mixed(s: Column) -> Column:
            """Whether windows that differ share the hash's upper bits, which may part equal ones."""
            upper = lambda x: F.shiftright(x, 24)
            clash = lambda x, i: F.coalesce((upper(F.get(s, i - 1)) == upper(x)) & (F.get(windows, F.get(s, i - 1).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")) != F.get(windows, x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))), F.lit(False))
            return F.exists(F.transform(s, clash), lambda x: x)

        return F.when(F.size(windows) >= least, let(slowly(windows), cover)).otherwise(let(coded, lambda s: F.when(mixed(s), let(slowly(windows), cover)).otherwise(let(repeats(s), cover))))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0).cast("bigint"))


#: The counts as expressions of _text; _words is its words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.when(F.contains(text, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, _text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    return d.select("doc_id", "_text", *[c.alias(name) for name, c in _counts(F.col("_text"), F.col("_words")).items()])


Values = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `test` of its values (_text and the counts it `needs`) is true.

    `work` is what a text costs it, in SQL over the same values; counts that don't exist yet cost more.
    """

    name: str
    test: Callable[[Values], Column]
    work: str = "1"
    needs: tuple[str, ...] = ()


#: Characters read to make each count; words are hashed five times and sorted for the windows.
COUNT_WORK = {"n_words": "length(_text)", "word_chars": "2 * length(_text)", "n_symbols": "length(_text)", "n_dup_lines": "2 * length(_text)", "n_repeat_words": "length(_text) + n_words * (10 + 2 * log2(n_words + 1))"}

BASE_RULES = (
    Rule("few_words", lambda v: v["n_words"] < 10, "1", ("n_words",)),
    Rule("repeats", lambda v: v["n_repeat_words"] * 100 > v["n_words"] * 20, "1", ("n_words", "n_repeat_words")),
)

RULES = (
    Rule("word_length", lambda v: (v["word_chars"] < v["n_words"] * 2) | (v["word_chars"] > v["n_words"] * 14), "1", ("n_words", "word_chars")),
    Rule("symbols", lambda v: v["n_symbols"] * 10 > v["word_chars"], "1", ("n_symbols", "word_chars")),
    Rule("dup_lines", lambda v: (v["n_dup_lines"] > 5) & (v["n_dup_lines"] * 2 > F.regexp_count(v["_text"], F.lit("\n")) + 1), "if(n_dup_lines > 5, length(_text), 1)", ("n_dup_lines",)),
    Rule("few_letters", lambda v: F.regexp_count(v["_text"], F.lit(r"\p{L}")) * 2 < v["word_chars"], "2 * length(_text)", ("word_chars",)),
    Rule("long_word", lambda v: v["_text"].rlike(r"[^\x20\x09-\x0D]{1000}"), "length(_text)"),
    Rule("bars", lambda v: F.regexp_count(v["_text"], F.lit("[|]")) * 4 > v["n_words"], "length(_text)", ("n_words",)),
)

def _stored() -> Values:
    return {name: F.col(name) for name in ("_text", *COUNTS)}


def ordered(sample: DataFrame, rules: tuple[Rule, ...] = RULES, *, made: bool = True) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, work a text) in the order of rejections per work on the sample, ties by name.

    sample has _text and the counts. made: the counts exist before the cascade; if not, their work is the rule's too.
    """
    seen = []
    for rule in rules:
        work = " + ".join([rule.work, *([] if made else [COUNT_WORK[c] for c in rule.needs])])
        seen += [F.sum(rule.test(_stored()).cast("int")), F.sum(F.expr(f"cast({work} as double)"))]
    got = sample.agg(F.count("*"), *seen).first()
    rows = max(1, got[0])
    out = [(rule, (got[2 * i + 1] or 0) / rows, max((got[2 * i + 2] or 0.0) / rows, 1.0)) for i, rule in enumerate(rules)]
    return sorted(out, key=lambda r: (-r[1] / r[2], r[0].name))


def spread_sample(docs: DataFrame, rows: int) -> DataFrame:
    """Counts of about `rows` texts, spread over the table by a hash of the row; only ever used to order rules."""
    share = min(1.0, rows / max(1, docs.count()))
    own = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    return base_counts(own.limit(4 * rows)).drop("doc_id")  # rows that are repeated very often are chosen together


def _verdict(cascade: list[Rule], last: Column) -> Column:
    for rule in reversed(cascade):
        last = F.when(rule.test(_stored()), F.lit(rule.name)).otherwise(last)
    return last


def quality_rules(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by (the first rule that rejects, in cascade order) of every row."""
    verdict = _verdict([r for r, _, _ in ordered(spread_sample(docs, sample_rows), rules)], F.lit(None).cast("string"))
    failed = BASE_RULES[0].test(_stored()) | BASE_RULES[1].test(_stored())
    d = base_counts(docs).select("doc_id", *COUNTS, failed.alias("base_failed"), F.when(failed, F.lit("base")).otherwise(verdict).alias("rejected_by"))
    return d.select("doc_id", *COUNTS, "base_failed", F.isnull("rejected_by").alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """docs' rows and columns, without those that a base rule or a rule rejects.

    Counts are made inside the cascade, where the first rule that reads them asks for them, so a text that a cheap
    rule rejects never has its windows sorted.
    """
    cascade = [r for r, _, _ in ordered(spread_sample(docs, sample_rows), (*BASE_RULES, *rules), made=False)]
    names = docs.columns
    text = F.col("_text")

    def judged(left: list[Rule], known: Values) -> Column:
        """Whether no rule that is left rejects; evaluated step by step, as branches are."""
        if not left:
            return F.lit(True)
        rule = left[0]
        lacking = [c for c in rule.needs if c not in known]
        if lacking and "_words" not in known and lacking[0] not in ("n_symbols", "n_dup_lines"):
            return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: judged(left, known | {"_words": w}))
        if lacking:
            return let(_counts(text, known.get("_words", F.array()))[lacking[0]], lambda x: judged(left, known | {lacking[0]: x}))
        return F.when(rule.test(known), False).otherwise(judged(left[1:], known))

    d = docs.select(*[F.col(f"`{c}`").alias(f"_c_{c}") for c in names], F.coalesce("text", F.lit("")).alias("_text"))
    return d.where(judged(cascade, {"_text": text})).select(*[F.col(f"`_c_{c}`").alias(c) for c in names])


#: The same rows but for rejected_by, whose value depends on the order.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
g AS (SELECT rid, pos, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS f FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, CASE WHEN f IS NOT NULL THEN count(*) OVER (PARTITION BY rid, word, b, c, e, f) ELSE 0 END AS n FROM g),
v AS (SELECT rid, max(n) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM r),
rep AS (SELECT rid, count(*) FILTER (WHERE n >= 2) AS n_repeat_words FROM v GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT doc_id, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > word_chars
    OR (n_dup_lines > 5 AND 2 * n_dup_lines > len(regexp_extract_all(t, '\n')) + 1) OR 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars
    OR regexp_matches(t, '[^\x20\x09-\x0D]{1000}') OR 4 * len(regexp_extract_all(t, '[|]')) > n_words) AS kept
FROM judged
"""
