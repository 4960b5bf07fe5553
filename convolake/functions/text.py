"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, spelt out so that every engine's regular expressions agree.
SPACES = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKEN = "[a-z0-9ı]+(?:'[a-z0-9ı]+)?"
UNICODE_WORD = r"[\p{L}\p{N}_]+"
CLOCK = r"^\s*([0-9]+):([0-5][0-9]):([0-5][0-9](?:\.[0-9]+)?)\s*$"


def let(value: Column, body) -> Column:
    """Binds value once for body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def _folded() -> dict[str, str]:
    """Characters whose case folding is more than their lower case, and holds a letter that tokens keep."""
    every = {chr(c): chr(c).casefold() for c in range(0x80, 0x10000)}
    return {a: b for a, b in every.items() if b != a.lower() and any("a" <= x <= "z" for x in b)}


def fold(text: Column) -> Column:
    """Case folding: lower case, sharp and long s and ligatures resolved, the curly apostrophe made plain."""
    table = _folded()
    whole = text
    for a, b in table.items():
        whole = F.replace(whole, F.lit(a), F.lit(b))
    text = F.when(text.rlike(f"[{''.join(table)}]"), whole).otherwise(text)
    return F.replace(F.lower(text), F.lit("’"), F.lit("'"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without(toks: Column, words: tuple[str, ...]) -> Column:
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNICODE_WORD)).cast("long")


def has_phrase(toks: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the tokens hold one of the phrases as whole tokens."""
    hay = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return let(hay, lambda h: F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(h, p)))


def is_question(text: Column, toks: Column, starters: tuple[str, ...]) -> Column:
    return F.contains(text, F.lit("?")) | F.coalesce(F.get(toks, F.lit(0)).isin(*starters), F.lit(False))


def matches_between(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs between characters that belong to no word, whatever the case."""
    return text.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{pattern})([^\p{{L}}\p{{N}}_]|$)")


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS[.f]; null for anything else."""
    part = lambda i: F.regexp_extract(text, CLOCK, i).try_cast("double")
    return F.when(text.rlike(CLOCK), part(1) * 3600 + part(2) * 60 + part(3))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
