"""Folds, calibration, blends and metrics of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-6


def logit(p: Column, eps: float = EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q) - F.log1p(-q)


def platt(p: Column, a: float, b: float) -> Column:
    """sigmoid(a logit(p) + b); the slope has to be positive."""
    if not a > 0:
        raise ValueError("the slope must be positive")
    return 1 / (1 + F.exp(-(F.lit(a) * logit(p) + F.lit(b))))


def blend(parts: list[tuple[Column, float]], floor: float = EPS) -> Column:
    if any(w < 0 for _, w in parts) or abs(sum(w for _, w in parts) - 1) > 1e-9:
        raise ValueError("weights must not be negative and must sum to 1")
    total = sum((c * w for c, w in parts[1:]), parts[0][0] * parts[0][1])
    return F.least(F.greatest(total, F.lit(floor)), F.lit(1 - floor))


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def roc_auc(df: DataFrame, *keys: str) -> DataFrame:
    """Exact rank statistic with ties at a half; null where a class is missing. Columns y and p."""
    by_score = df.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    d = by_score.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    d = d.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return d.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).cast("double").alias("auc"))


def ece(df: DataFrame, bins: int = 10, *keys: str) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    d = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("p").alias("p"))
    return d.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def snake_folds(df: DataFrame, group: str, y: str, n: int, seed: int = 0) -> DataFrame:
    """Group to fold: groups by positives, then size, dealt back and forth. One row a group, so one task orders them."""
    g = df.groupBy(group).agg(F.sum(y).cast("long").alias("pos"), F.count("*").cast("long").alias("size"))
    tie = F.md5(F.concat(F.col(group).cast("string"), F.lit(str(seed))).cast("binary"))
    i = F.row_number().over(Window.orderBy(F.col("pos").desc(), F.col("size").desc(), tie)) - 1
    turn, place = F.expr(f"_i div {n}"), F.col("_i") % n
    fold = F.when(turn % 2 == 0, place).otherwise(n - 1 - place)
    return g.withColumn("_i", i).select(group, "pos", "size", fold.cast("int").alias("fold"))


def splits(df: DataFrame, folds: DataFrame, group: str, session: str, fold: int) -> DataFrame:
    """df with split: validation, purged (its session is in validation) or train."""
    d = df.join(folds.select(group, "fold"), group)
    held = d.where(F.col("fold") == fold).select(session).distinct().withColumn("_held", F.lit(True))
    d = d.join(held, session, "left")
    return d.withColumn("split", F.when(F.col("fold") == fold, "validation").when(F.col("_held"), "purged").otherwise("train")).drop("_held")


def stratified_folds(df: DataFrame, group: str, y: str, n: int, seed: int = 0) -> DataFrame:
    """Group to fold, one at a time: the largest groups first, then those of the widest label counts, each to the fold that keeps the folds' shares of each class most even.

    Ties go to the smaller fold, then the lower number; a hash with the seed orders equal groups. Only counts
    of groups meet in one task (a row a group), as each step depends on all before.
    """
    g = df.groupBy(group).agg(F.sum(y).cast("long").alias("pos"), F.count("*").cast("long").alias("size"))
    g = g.withColumn("_tie", F.md5(F.concat(F.col(group).cast("string"), F.lit(str(seed))).cast("binary")))

    def deal(frame):
        import numpy as np

        frame = frame.assign(_std=np.abs(frame["size"] - 2 * frame["pos"]) / 2).sort_values(["size", "_std", "_tie"], ascending=[False, False, True], kind="stable")
        counts = np.stack([frame["size"] - frame["pos"], frame["pos"]], 1).astype(float)
        total, folds, out = np.maximum(counts.sum(0), 1), np.zeros((n, 2)), []
        for c in counts:
            best = min(range(n), key=lambda k: (round(float(np.std((folds + c * (np.arange(n) == k)[:, None]) / total, axis=0).mean()), 12), folds[k].sum(), k))
            folds[best] += c
            out.append(best)
        return frame.assign(fold=out)[[group, "pos", "size", "fold"]]

    if g.limit(n).count() < n:
        raise ValueError("more folds than groups")
    return g.groupBy().applyInPandas(deal, f"{group} {dict(df.dtypes)[group]}, pos long, size long, fold int")


def family_folds(df: DataFrame, families: DataFrame, group: str, y: str, n: int, seed: int = 0) -> DataFrame:
    """df with family and fold, by folds of whole families; families: group, family. A group without a family fails."""
    d = df.join(families.select(group, "family"), group, "left")
    d = d.withColumn("family", F.when(F.col("family").isNull(), F.raise_error(F.concat(F.lit("no family for "), F.col(group).cast("string"))).cast(dict(families.dtypes)["family"])).otherwise(F.col("family")))
    return d.join(snake_folds(d, "family", y, n, seed).select("family", "fold"), "family")


def isolation_faults(split: DataFrame, *keys: str) -> DataFrame:
    """key, n_shared: values that train and validation share."""
    out = None
    for k in keys:
        sides = split.where("split <> 'purged'").groupBy(k).agg(F.countDistinct("split").alias("n")).where("n > 1")
        part = sides.agg(F.count("*").cast("long").alias("n_shared")).select(F.lit(k).alias("key"), "n_shared")
        out = part if out is None else out.unionByName(part)
    return out


def probability_faults(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts of rows a metric can't take: labels that are not 0 or 1, values that are no probability."""
    v = F.col(p)
    return df.agg(F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).cast("long").alias("bad_labels"), F.count_if(v.isNull() | F.isnan(v) | (v < 0) | (v > 1)).cast("long").alias("bad_probabilities"))
