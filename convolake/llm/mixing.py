"""Mixing of sources to target weights by weighted sampling without replacement.

Every document draws a key -ln(u) / w, u from a hash of its id and w its quality weight, and its
source is read in the order of its keys (Efraimidis and Spirakis). A source whose target is beyond
its size is taken whole as often as it fits, and only what is left is drawn. Targets share the total
by weight, capped at `most_epochs` times a source's size; the closed form of sharing the excess again
and again is a water level, found with window sums over the table of sources.

The prefix sums within a source run in two levels: documents fall into buckets of the key, whose
sizes are summed first, and only documents of one bucket meet in a task. A source with a third of
all rows is thus spread over its buckets.

Defined results: null text has size 0 and is taken as often as its epoch; a null source is a source,
the last in order; rows of the same id are drawn one by one, ties by size; an empty table gives an
empty result; without any word every target is 0; other columns are ignored by `mix_plan` and kept by
`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolake.llm.common import WORD

WEIGHTS = (5, 2, 1)
#: Buckets of the key within a source: this many, and one for each BUCKET_ROWS documents if that is more.
LEAST_BUCKETS, BUCKET_ROWS = 256, 5000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text without words, else 1 plus the share of its characters that are not ASCII symbols or digits, squared."""
    plain = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[#*$%&|<>0-9]", "")).cast("double")
    return F.lit(1.0) + F.when(F.length(text) > 0, F.pow(plain / F.length(text), F.lit(2.0))).otherwise(0.0)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id's MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """source, source_size, target. sizes: source, source_size - one row a source, which a single task orders."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    t = sizes.withColumn("_w", weight)
    whole = Window.partitionBy()
    t = t.withColumn("_cap", F.col("source_size") * float(most_epochs)).withColumn("_total", F.sum("source_size").over(whole).cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0))).withColumn("_free", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(by_level), F.lit(0.0)))
    full = F.col("_capped") + F.col("_cap") / F.col("_w") * F.col("_free") <= F.col("_total")
    t = t.withColumn("_full", full)
    t = t.withColumn("_rest", F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)).withColumn("_share", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(whole))
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_rest") / F.when(F.col("_share") > 0, F.col("_share"))).alias("target"))


def _planned(docs: DataFrame, carry: list[str], weights: tuple[int, ...], most_epochs: int, seed: int, buckets: int | None) -> DataFrame:
    """The plan under names of its own (`_p_`), beside carried columns (`_c_`), so no names clash."""
    if buckets is None:
        buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    d = docs.select(F.col("doc_id").alias("_p_doc_id"), F.col("source").alias("_p_source"), *[F.col(f"`{c}`").alias(f"_c_{c}") for c in carry], n_words(F.col("text")).alias("_p_size"), (-F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"))).alias("_key"))
    # a monotone bucket of the key: u^(1/w) is nearly uniform
    d = d.withColumn("_bucket", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.lit(buckets)).cast("int"))
    cells = d.groupBy("_p_source", "_bucket").agg(F.sum("_p_size").alias("_cell"))
    before = Window.partitionBy("_p_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    targets = source_targets(cells.groupBy(F.col("_p_source").alias("source")).agg(F.sum("_cell").alias("source_size")), weights, most_epochs)
    targets = targets.select(F.col("source").alias("_t"), F.col("source_size").alias("_p_source_size"), F.coalesce("target", F.lit(0.0)).alias("_p_target"))
    cells = cells.select(F.col("_p_source").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    cells = cells.join(targets, F.col("_s").eqNullSafe(F.col("_t")))
    inner = Window.partitionBy("_p_source", "_bucket").orderBy("_key", "_p_doc_id", "_p_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_p_size").over(inner), F.lit(0)))
    d = d.join(cells, d["_p_source"].eqNullSafe(F.col("_s")) & (d["_bucket"] == F.col("_b")))
    whole = F.when(F.col("_p_source_size") > 0, F.floor(F.col("_p_target") / F.col("_p_source_size"))).otherwise(0).cast("long")
    lacks = F.col("_p_target") - whole * F.col("_p_source_size")
    drawn = (F.col("_before") + F.col("_in") + F.col("_p_size") / 2.0 <= lacks) & (F.col("_p_size") > 0)
    return d.withColumn("_p_epochs", F.least(whole + F.when(drawn, 1).otherwise(0), F.lit(most_epochs)).cast("long"))


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3, seed: int = 7, buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken, a row per document.

    A document is drawn while the middle of its words lies below what its source lacks, so a source
    misses its target by at most half a document.
    """
    d = _planned(docs, [], weights, most_epochs, seed, buckets)
    return d.select(*[F.col(f"_p_{c}").alias(c) for c in ("doc_id", "source", "size", "source_size", "target", "epochs")], (F.col("_p_size") * F.col("_p_epochs")).alias("taken"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3, seed: int = 7, buckets: int | None = None) -> DataFrame:
    """The mix itself: docs' rows and columns, each as often as the plan takes it."""
    d = _planned(docs, docs.columns, weights, most_epochs, seed, buckets).where("_p_epochs > 0")
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_p_epochs").cast("int"))))
    return d.select(*[F.col(f"`_c_{c}`").alias(c) for c in docs.columns])


#: op7's rows. Sizes, keys, the water level and the two-level prefix sums of the operator in plain SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)
      / (1::DOUBLE + CASE WHEN length(text) > 0 THEN power(length(regexp_replace(text, '[#*$%&|<>0-9]', '', 'g'))::DOUBLE / length(text), 2) ELSE 0 END) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 3::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, all_w - coalesce(sum(w) OVER o, 0) AS free FROM c
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, capped + cap / w * free <= total AS is_full FROM l),
t AS (SELECT source, source_size, coalesce(CASE WHEN is_full THEN cap ELSE w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) END, 0) AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, least(whole + CASE WHEN before + size / 2::DOUBLE <= target - whole * source_size AND size > 0 THEN 1 ELSE 0 END, 3)::BIGINT AS epochs FROM p)
SELECT doc_id, size, source_size, target, size * epochs AS taken, source, epochs FROM e
"""
