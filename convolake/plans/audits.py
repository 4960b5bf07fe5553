"""Audits of tables and stores: reports of counts, never of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators.vectors import bucket


def field_digest(*columns: str) -> Column:
    """SHA-256 of a row's fields, each with its length before it, so that no two rows run together; null differs from empty."""
    parts = [F.when(F.col(c).isNull(), F.lit("-1:")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def table_digest(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """part, n, digest of the rows in the order of a unique key; parts are of the key's hash, so no task holds all rows."""
    d = df.select(F.col(order).alias("_o"), bucket(F.col(order).cast("string"), parts).alias("part"), field_digest(*columns).alias("_h"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])
    return d.groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("digest"))


def parity(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """only_left, only_right, different, same: rows of two tables by a unique key and a digest of their columns."""
    a, b = (d.select(key, field_digest(*columns).alias(h)) for d, h in ((left, "_a"), (right, "_b")))
    j = a.join(b, key, "full_outer")
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(F.col("_a") != F.col("_b")).alias("different"),
        F.count_if(F.col("_a") == F.col("_b")).alias("same"),
    )


def file_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same of two listings of files (name, size, sha256): folders, archives or both."""
    return parity(left, right, "name", ["size", "sha256"])


def contiguous(df: DataFrame, key: str = "row_id") -> DataFrame:
    """n, n_distinct, lowest, highest and whether the ids are 0 to n - 1."""
    d = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct"), F.min(key).alias("lowest"), F.max(key).alias("highest"))
    return d.withColumn("contiguous", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1), F.col("n") == 0))


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_bad: nulls, NaN and infinities of each column, in one pass."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_bad")) for i, c in enumerate(columns)])
    return df.agg(*bad).select(F.explode(rows).alias("r")).select("r.*")


def view_audit(responses: DataFrame, views: DataFrame, lines: DataFrame) -> DataFrame:
    """check, n_bad: sessions without a view, views without lines, line counts and characters that differ, repeated sessions."""
    own = lines.groupBy("session_id").agg(F.count("*").alias("_lines"), F.sum(F.length("content")).alias("_chars"))
    j = views.join(own, "session_id", "full_outer")
    checks = {
        "response without view": responses.select("session_id").distinct().join(views, "session_id", "left_anti").agg(F.count("*").alias("n")),
        "view without lines": j.agg(F.count_if(F.col("_lines").isNull()).alias("n")),
        "lines without view": j.agg(F.count_if(F.col("utterance_count").isNull()).alias("n")),
        "line counts differ": j.agg(F.count_if(F.col("utterance_count") != F.col("_lines")).alias("n")),
        "characters differ": j.agg(F.count_if(F.col("char_count") != F.col("_chars")).alias("n")),
        "repeated sessions": views.agg((F.count("*") - F.countDistinct("session_id")).alias("n")),
    }
    out = None
    for name, d in checks.items():
        part = d.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n_bad"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_faults(report: dict, components: tuple[str, ...], folds: int) -> list[str]:
    """What a metrics report lacks before it counts as evidence: components, finite metrics, folds, and a gate that agrees with them."""
    import math

    wrong, names = [], ("log_loss", "roc_auc", "brier", "ece10")
    for c in components:
        found = report.get("components", {}).get(c)
        if found is None:
            wrong.append(f"no {c}")
        elif any(not isinstance(found.get(m), int | float) or not math.isfinite(found[m]) for m in names):
            wrong.append(f"metrics of {c}")
    if len(report.get("folds", [])) != folds:
        wrong.append("folds")
    if not wrong:
        losses = {c: report["components"][c]["log_loss"] for c in components}
        passed = all(losses["ensemble"] < v for c, v in losses.items() if c != "ensemble")
        if report.get("promotion_gate", {}).get("passed") is not passed:
            wrong.append("gate")
    return wrong
