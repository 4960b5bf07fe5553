"""Keys, joins and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _place(key: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds lie below key, by halving; all of them for a null key."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key <= F.lit(bounds[mid]), _place(key, bounds[:mid], first)).otherwise(_place(key, bounds[mid + 1 :], first + mid + 1))


def with_row_id(df: DataFrame, order: str, parts: int = 64, sample_rows: int = 6400) -> DataFrame:
    """Dense 0-based ids by a unique key, a null one last: counts per key range, then a row number inside each.

    A row's range depends on its key alone, so every pass over df agrees on it, however partitions are cut or merged.
    The bounds are quantiles of a bounded sample; they only balance the ranges.
    """
    sample = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(sample_rows).collect()
    keys = sorted(r[0] for r in sample)
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    d = df.withColumn("_p", _place(F.col(order), bounds))
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(F.col(order).asc_nulls_last())) - 1)
    return d.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn("row_id", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias("n")).where("n > 1")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def null_or_empty(df: DataFrame) -> DataFrame:
    """Rows per column that are null or have no character, in one pass."""
    counts = [F.count_if(F.col(c).isNull() | (F.length(F.col(c).cast("string")) == 0)).cast("long").alias(c) for c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns])
    return df.agg(*counts).select(F.explode(pairs).alias("p")).select("p.*")


def purge(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Training rows whose key validation doesn't have."""
    return train.join(validation.select(key).distinct(), key, "left_anti")


def map_dimension(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """N:1 lookup; a key that the dimension lacks fails the query."""
    found = df.join(dim.select(key, value), key, "left")
    return found.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(key).cast("string")))).otherwise(F.col(value)))


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An inner or left join that fails if a key is repeated on either side."""
    for side, df in (("left", left), ("right", right)):
        twice = duplicate_keys(df, key).limit(3).collect()
        if twice:
            raise ValueError(f"{key} is repeated on the {side}: {[r[key] for r in twice]}")
    return left.join(right, key, how)


def aligned(*parts: DataFrame, key: str) -> DataFrame:
    """Column blocks side by side by a key that all hold exactly once; fails if one lacks rows."""
    out = parts[0]
    for part in parts[1:]:
        if key_difference(out, part, key).limit(1).count():
            raise ValueError(f"blocks differ in {key}")
        out = one_to_one(out, part, key)
    return out


def unsafe_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name would leave a folder: empty, a separator, a dot name or a null character."""
    c = F.col(name)
    return df.where(c.isNull() | (c == "") | c.isin(".", "..") | c.rlike(r"[/\\\\\x00]"))


def missing_sessions(responses: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions that responses name and no file holds; files: stem."""
    return responses.select("session_id").distinct().join(files.select(F.col("stem").alias("session_id")), "session_id", "left_anti")
