"""Personal data by candidate generation and boosted trees, in DataFrame functions only.

Generators with high recall propose spans that may overlap: the four base patterns, also where the
base checks fail, e-mail addresses spelt with "at" and "dot" (parts of at most 64 characters, as in
addresses), and telephone numbers without a country code. Every candidate gets format features
(digits, separators, checksum, octets, grouping) and context features (what stands before and after
it), and boosted trees score it. The trees are trained on candidates cut from strings written by
templates with a fixed seed, and the threshold of each kind is calibrated on the candidates of other
strings that fail the base checks, so that at least `precision` of what passes is personal. A base
match that passes its own check is always kept; other candidates are added if they reach their kind's
threshold and touch no base span and no better candidate that was added.

Work grows in proportion to the text: places are running sums, and only spans that overlap are
compared.

The trees run as CASE expressions. Texts without a digit or a spelt "at" never reach the generators.

Defined results: null text is empty; an empty text has no spans; repeated rows are treated alike; an
empty table gives an empty result; other columns are kept by `redact` and ignored by `find_pii`.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import let

KINDS = ("email", "ip", "card", "phone")
FEATURES = ("kind", "length", "digits", "separators", "luhn", "octets", "grouped", "base_form", "cue", "anti_cue", "glued_before", "glued_after", "spelt_tld")

# The base patterns, as they are found from left to right. A match can only begin where a run of its
# first class begins, or where the last match ended (\G); the look-behind spares all other starts.
_NAME = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
# runs of fewer than 12 digits never pass, so they are not matched; Java repeats a group on its stack unless the
# repetition is possessive, which finds the same here, as nothing follows it
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,64}+(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,64}+)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"

CUES = r"(?:tel|telephone|phone|call|mobile|cell|fax|contact|reach|e-?mail|mail|write|card|visa|mastercard|ip|address|host)\W{0,3}(?:\w{1,4}\W)?$"
ANTI_CUES = r"(?:order|invoice|ref|reference|id|isbn|issn|serial|version|ver|item|part|sku|lot|code|case|page|no)\W{0,3}$"
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")


#: Values that are appended to one array, and code points of a block of text.
RUN, BLOCK = 64, 4096

SEPARATOR = r"[\x20().-]"
GROUPED = r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,3})$"
GLUED_BEFORE, GLUED_AFTER = r"[\p{L}0-9#_/=-]$", r"^[\p{L}0-9_/=%-]"
SPELT_TLD = rf"(?:dot|\.)\W{{0,2}}(?:{'|'.join(TLDS)})$"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + let(F.ascii(F.substring(digits, n - i + 1, 1)) - 48, lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
    )
    return F.when(n > 0, value % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(match, "\\."), lambda p: F.lpad(F.right(p, F.lit(3)), 3, "0") <= "255")


def running(values: Column, join) -> Column:
    """For each of an array of longs, what join makes of 0 and the values before it; then that of all.

    Arrays can only be appended to by a copy, so runs of RUN values are joined first, and then the runs.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def grown(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def joined(runs: Column) -> Column:
        ends = grown(F.transform(runs, lambda r: F.element_at(r, -1)))
        inner = let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: join(F.get(e, i), x)))))
        return F.concat(inner, F.array(F.element_at(ends, -1)))

    def cut(v: Column) -> Column:
        many = F.ceil(F.size(v) / RUN).cast("int")
        return F.when(F.size(v) > 0, let(F.transform(F.sequence(F.lit(0), many - 1), lambda i: grown(F.slice(v, i * RUN + 1, F.lit(RUN)))), joined)).otherwise(zero)

    return let(values, cut)


def scan(text: Column, pattern: str, kind: str, form: int) -> Column:
    """All matches of a pattern as structs of kind, form, start, end, match, before and after."""
    empty = F.expr("cast(array() as array<struct<kind:int,form:int,start:bigint,end:bigint,match:string,before:string,after:string>>)")

    def spans(gaps: Column, hits: Column) -> Column:
        def one(hit: Column, i: Column, passed: Column) -> Column:
            start = F.get(passed, i) + F.length(F.get(gaps, i))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(form).alias("form"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("match"), F.lower(F.right(F.get(gaps, i), F.lit(24))).alias("before"), F.left(F.get(gaps, i + 1), F.lit(4)).alias("after"))

        sizes = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("bigint"))
        return F.when(F.size(hits) > 0, let(running(sizes, lambda x, y: x + y), lambda passed: F.transform(hits, lambda h, i: one(h, i, passed)))).otherwise(empty)

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: spans(gaps, hits)))


def features(c: Column) -> list[Column]:
    """The features of a candidate, in the order of FEATURES."""
    m = c["match"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    return [
        c["kind"].cast("double"),
        (c["end"] - c["start"]).cast("double"),
        F.length(digits).cast("double"),
        _count(m, SEPARATOR).cast("double"),
        yes((c["kind"] == 2) & (F.length(digits) <= 19) & luhn(F.left(digits, F.lit(20)))),
        yes((c["kind"] == 1) & _octets(m)),
        yes(m.rlike(GROUPED)),
        c["form"].cast("double"),
        yes(c["before"].rlike(CUES)),
        yes(c["before"].rlike(ANTI_CUES)),
        yes(c["before"].rlike(GLUED_BEFORE)),
        yes(c["after"].rlike(GLUED_AFTER)),
        yes(F.lower(m).rlike(SPELT_TLD)),
    ]


@dataclass(frozen=True)
class Candidate:
    kind: int
    form: int
    match: str
    before: str
    after: str


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _luhn(digits: str) -> bool:
    return bool(digits) and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_features(c: Candidate) -> list[float]:
    """What `features` gives, for training."""
    digits, octets = _digits(c.match), c.match.split(".")
    return [
        float(c.kind),
        float(len(c.match)),
        float(len(digits)),
        float(len(re.findall(SEPARATOR, c.match))),
        float(c.kind == 2 and len(digits) <= 19 and _luhn(digits)),
        float(c.kind == 1 and all(int(o) <= 255 for o in octets)),
        float(bool(re.search(GROUPED, c.match))),
        float(c.form),
        float(bool(re.search(CUES, c.before, re.A))),
        float(bool(re.search(ANTI_CUES, c.before, re.A))),
        float(bool(c.before and (c.before[-1].isalpha() or c.before[-1] in "0123456789#_/=-"))),
        float(bool(c.after and (c.after[0].isalpha() or c.after[0] in "0123456789_/=%-"))),
        float(bool(re.search(SPELT_TLD, c.match.lower(), re.A))),
    ]


def plain_passes(c: Candidate) -> bool:
    """What `base_passes` gives, for calibration."""
    n = len(_digits(c.match))
    if c.form != 1:
        return False
    return (True, c.kind == 1 and all(int(o) <= 255 for o in c.match.split(".")), 12 <= n <= 19 and _luhn(_digits(c.match)), 9 <= n <= 15)[c.kind]


def base_passes(c: Column) -> Column:
    """Whether a candidate of a base pattern passes the base check of its kind."""
    digits = F.regexp_replace(c["match"], "[^0-9]", "")
    n = F.length(digits)
    return (c["form"] == 1) & (
        F.when(c["kind"] == 0, True)
        .when(c["kind"] == 1, _octets(c["match"]))
        .when(c["kind"] == 2, n.between(12, 19) & luhn(F.left(digits, F.lit(20))))
        .otherwise(n.between(9, 15))
    )


# ---- the trees -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosted:
    """Trees as nested tuples (feature, split, below, above) or leaf values, and a threshold by kind."""

    bias: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([self.bias + sum(walk(t, row) for t in self.trees) for row in x])

    def expression(self, f: list[Column]) -> Column:
        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + case(tree)
        return total


_NEUTRAL = ("the", "and", "of", "we saw", "there were", "in", "about", "then", "with", "over")
_CUED = ("tel", "phone", "call", "mobile", "fax", "contact", "reach", "e-mail", "mail", "write to", "card", "visa", "address", "host")
_ANTI = ("order", "invoice", "ref", "id", "isbn", "serial", "version", "item", "part", "sku", "lot", "code", "case", "page")
_WORDS = ("anna", "jo", "smith", "lee", "info", "sales", "office", "river", "north", "blue", "garden", "site", "shop", "studio", "mill", "group")


def written(rng: np.random.Generator) -> tuple[str, bool]:
    """A line of text around one piece that may be personal, and whether it is."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    some = lambda p: bool(rng.random() < p)
    name = pick(_WORDS) + (pick(("", ".", "_", "-")) + pick(_WORDS) if some(0.6) else "") + (number(2) if some(0.2) else "")
    kind, personal = pick(("email", "spelt", "ip", "card", "phone", "local")), some(0.5)
    cues = _CUED if personal else _NEUTRAL + _ANTI
    glue = "" if personal or some(0.7) else pick(("#", "/", "=", "x", "-"))
    if kind == "email":
        piece, personal = f"{name}@{pick(_WORDS)}{number(1) if some(0.3) else ''}.{pick(TLDS) if some(0.8) else 'example'}", True
        cues = _CUED + _NEUTRAL
    elif kind == "spelt":
        at, dot = pick(((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] ")))
        piece = f"{name}{at}{pick(_WORDS)}{dot}{pick(TLDS)}" if personal else f"{pick(_NEUTRAL)} at {pick(_WORDS)} dot {pick(_WORDS)}"
        cues, glue = _CUED + _NEUTRAL if personal else _NEUTRAL, ""
    elif kind == "ip":
        parts = [str(int(rng.integers(0, 256))) for _ in range(4)]
        if not personal:
            parts[int(rng.integers(4))] = str(int(rng.integers(256, 5000)))
        piece = ".".join(parts)
    elif kind == "card":
        body = number(15 if some(0.8) else int(rng.integers(11, 19)))
        body += next(d for d in "0123456789" if _luhn(body + d))
        if personal and some(0.4):  # with a slip
            at = int(rng.integers(len(body)))
            body = body[:at] + str((int(body[at]) + 1) % 10) + body[at + 1 :]
        elif not personal:
            body = number(int(rng.integers(12, 30)))
        gap = pick(("", " ", "-")) if len(body) == 16 else ""
        piece = gap.join(body[i : i + 4] for i in range(0, len(body), 4))
        cues = ("card", "visa", "mastercard") if personal else cues
    elif kind == "phone":
        gap = pick((" ", "-", "."))
        piece = f"+{rng.integers(1, 99)} {pick(('({})', '{}')).format(number(3))}{gap}{number(3)}{gap}{number(4)}"
        if not personal:
            piece = "+" + pick((f"{number(2)}-{number(2)}", gap.join(number(2) for _ in range(int(rng.integers(9, 14)))), number(int(rng.integers(16, 24)))))
    else:
        piece = pick(("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}")).format(number(3), number(3), number(4))
        cues = ("tel", "phone", "call", "mobile", "fax", "contact", "reach") if personal else cues
    before = f"{pick(_NEUTRAL)} {pick(cues)}{pick((' ', ': ', ' ')) if not glue else ' '}{glue}"
    return f"{before}{piece}{pick((' ', '.', ', ', ' now', '')) if personal or some(0.8) else pick(('-a', '/2', '%'))}", personal


_PATTERNS = ((0, 1, EMAIL), (1, 1, IP), (2, 1, CARD), (3, 1, PHONE), (0, 0, SPELT_EMAIL), (3, 0, LOCAL_PHONE))


def candidates_of(line: str) -> list[Candidate]:
    """The candidates of a line, found as `scan` does."""
    import regex

    out = []
    for kind, form, pattern in _PATTERNS:
        found = list(regex.finditer(pattern, line, regex.A))
        ends = [0, *[m.end() for m in found]]
        starts = [*[m.start() for m in found[1:]], len(line)]
        out += [Candidate(kind, form, m[0], line[last : m.start()][-24:].lower(), line[m.end() : after][:4]) for m, last, after in zip(found, ends, starts, strict=False)]
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    leaf = float(np.round(-rate * g.sum() / (h.sum() + 1.0), 6))
    if depth == 0 or len(x) < 40:
        return leaf
    best, base = (1e-6, None), g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            if gain > best[0] + 1e-9 and 10 <= low.sum() <= len(x) - 10:
                best = (gain, (f, float(cut)))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low = x[:, f] <= cut
    return (f, cut, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate))


@lru_cache
def trained(n: int = 3000, trees: int = 16, depth: int = 3, rate: float = 0.4, precision: float = 0.97, seed: int = 11) -> Boosted:
    """Trees fitted to n candidates of written lines, thresholds calibrated on those of n others that fail the base checks."""
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(2):
        rows: list[tuple[Candidate, bool]] = []
        while len(rows) < n:
            line, personal = written(rng)
            rows += [(c, personal) for c in candidates_of(line)]
        parts += rows[:n]
    x, y = np.array([plain_features(c) for c, _ in parts]), np.array([float(p) for _, p in parts])
    failing = np.array([not plain_passes(c) for c, _ in parts])
    fit, held = slice(0, n), slice(n, 2 * n)
    bias = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    model = Boosted(bias, (), ())
    at = np.full(n, bias)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        tree = _grow(x[fit], p - y[fit], p * (1 - p), depth, rate)
        grown.append(tree)
        at += Boosted(0.0, (tree,), ()).score(x[fit])
    model = Boosted(bias, tuple(grown), ())
    score = model.score(x[held])
    thresholds = []
    for kind in range(len(KINDS)):
        own = (x[held][:, 0] == kind) & failing[held]
        order = np.argsort(-score[own], kind="stable")
        good = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1) >= precision
        last = np.flatnonzero(good)
        # even odds at least, so that the tail that the precision allows is not taken along
        thresholds.append(max(0.0, float(score[own][order][last[-1]])) if len(last) else float("inf"))
    return Boosted(bias, tuple(grown), tuple(thresholds))


# ---- spans -----------------------------------------------------------------------------------


def _with_spans(df: DataFrame, model: Boosted) -> DataFrame:
    """Adds _base and _spans: arrays of (start, kind, end), sorted."""
    text = F.col("_text")
    none = F.expr("cast(array() as array<struct<kind:int,form:int,start:bigint,end:bigint,match:string,before:string,after:string>>)")
    digit = text.rlike("[0-9]")

    def when(gate: Column, found: Column) -> Column:
        return F.when(gate, found).otherwise(none)

    candidates = F.concat(
        when(F.contains(text, F.lit("@")), scan(text, EMAIL, "email", 1)),
        when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), scan(text, IP, "ip", 1)),
        when(text.rlike(CARD), scan(text, CARD, "card", 1)),
        when(F.contains(text, F.lit("+")), scan(text, PHONE, "phone", 1)),
        when(text.rlike(r"(?i)[(\[\s]dot[)\]\s]"), scan(text, SPELT_EMAIL, "email", 0)),
        when(text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), scan(text, LOCAL_PHONE, "phone", 0)),
    )
    gate = digit | F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[\s]dot[)\]\s]")
    df = df.withColumn("_cand", F.when(gate, candidates))

    def span(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))


    def above(c: Column) -> Column:
        limit = F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), c["kind"] + 1)
        return let(F.array(*features(c)), lambda f: model.expression([F.element_at(f, i + 1) for i in range(len(FEATURES))])) - limit

    def chosen(cand: Column) -> Column:
        base = F.transform(F.filter(cand, base_passes), span)
        scored = F.filter(F.transform(F.filter(cand, lambda c: ~base_passes(c)), lambda c: F.struct(above(c).alias("over"), span(c).alias("s"))), lambda c: c["over"] >= 0)
        ranked = F.concat(F.transform(base, lambda b: F.struct(F.lit(float("inf")).alias("over"), b.alias("s"))), scored)
        by_place = F.array_sort(F.transform(ranked, lambda c: F.struct(c["s"].alias("s"), c["over"].alias("over"))))
        empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")

        def add(acc: Column, c: Column) -> Column:
            hit = F.exists(acc, lambda b: (b["start"] < c["s"]["end"]) & (c["s"]["start"] < b["end"]))
            return F.when(hit & (c["o"] != float("-inf")), acc).otherwise(F.concat(acc, F.array(c["s"])))

        def settled(run: Column) -> Column:
            best_first = F.array_sort(F.transform(run, lambda c: F.struct((-c["over"]).alias("o"), c["s"].alias("s"))))
            return F.when(F.size(run) == 1, F.transform(run, lambda c: c["s"])).otherwise(F.aggregate(best_first, empty, add))

        def apart(p: Column) -> Column:
            """Runs of spans that overlap, each settled by itself."""
            reach = running(F.transform(p, lambda c: c["s"]["end"]), lambda x, y: F.greatest(x, y))
            begins = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(r, i) <= F.get(p, i)["s"]["start"]))
            runs = let(begins, lambda b: F.transform(b, lambda at, k: F.slice(p, at + 1, F.coalesce(F.get(b, k + 1), F.size(p)) - at)))
            return F.flatten(F.transform(runs, settled))

        return let(base, lambda b: F.struct(F.array_sort(b).alias("base"), F.when(F.size(scored) > 0, F.array_sort(let(by_place, apart))).otherwise(F.array_sort(b)).alias("spans")))

    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    df = df.withColumn("_chosen", F.when(F.size("_cand") > 0, let(F.col("_cand"), chosen)))
    return df.withColumn("_base", F.coalesce(F.col("_chosen.base"), empty)).withColumn("_spans", F.coalesce(F.col("_chosen.spans"), empty))


def _join(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(kind: int):
    return lambda s: s["kind"] == kind


def find_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row."""
    d = _with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), model or trained())
    count = [F.size(F.filter("_base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return d.select("doc_id", *count, F.sha2(_join(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _join(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Boosted | None = None, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by <KIND>; overlapping spans become one replacement. Columns stay as they are."""
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_c_{c}") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    d = _with_spans(hidden, model or trained())
    mark = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def part(b: Column, lo: Column, hi: Column) -> Column:
        """Code points lo to hi of the blocks' text; from one place on a block is never cut into more than once."""
        own = F.slice(b, F.floor(lo / BLOCK).cast("int") + 1, (F.floor((hi - 1) / BLOCK) - F.floor(lo / BLOCK) + 1).cast("int"))
        return F.when(hi > lo, F.substring(F.array_join(own, ""), (lo % BLOCK).cast("int") + 1, (hi - lo).cast("int"))).otherwise("")

    def cleaned(s: Column, b: Column, reach: Column) -> Column:
        kept = F.transform(s, lambda x, i: F.when((F.get(reach, i) <= x["start"]) | (i == 0), F.concat(part(b, F.get(reach, i), x["start"]), F.get(mark, x["kind"]))).otherwise(""))
        return F.concat(F.array_join(kept, ""), part(b, F.element_at(reach, -1), F.length("_text").cast("bigint")))

    reach = running(F.transform("_spans", lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    clean = let(blocks, lambda b: let(reach, lambda r: cleaned(F.col("_spans"), b, r)))
    return d.select(*[(F.when(F.size("_spans") > 0, clean).otherwise(F.col(f"_c_{c}")) if c == text else F.col(f"_c_{c}")).alias(c) for c in names])
