"""Transcripts, response tables, profiles and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSCRIPT = T.StructType([T.StructField(c, T.StringType()) for c in ("session_id", "utterance_id", "role", "content", "timestamp")])
RESPONSES = T.StructType([T.StructField(c, T.StringType()) for c in ("response_id", "session_id", "learning_objective_id", "learning_objective")])
LABELS = T.StructType([T.StructField("response_id", T.StringType()), T.StructField("is_correct", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV as strings; words like NA or null stay text, the header has to match."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """All sessions of a folder in one scan, one file a session; roles lower-cased, numeric ids in numeric order by later windows."""
    d = read_csv(spark, path, TRANSCRIPT).withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return d.withColumn("role", F.lower(F.trim("role")))


def transcript_faults(t: DataFrame) -> DataFrame:
    """One row per session that breaks the contract, with what is wrong."""
    s = t.groupBy("_stem").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.min("session_id").alias("session_id"),
        F.count("*").alias("n"),
        F.countDistinct("utterance_id").alias("ids"),
        F.count_if(~F.coalesce(F.col("role").isin("tutor", "student", "background"), F.lit(False))).alias("roles"),
    )
    wrong = F.array_compact(
        F.array(
            F.when(F.col("sessions") != 1, F.lit("sessions")),
            F.when(F.col("session_id") != F.col("_stem"), F.lit("name")),
            F.when(F.col("ids") != F.col("n"), F.lit("utterance ids")),
            F.when(F.col("roles") > 0, F.lit("roles")),
        )
    )
    return s.select("_stem", wrong.alias("faults")).where(F.size("faults") > 0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: csv, parquet, json (an array or an object) or jsonl/ndjson."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "json":
        return flatten(spark.read.option("multiLine", True).json(path))
    if kind in ("jsonl", "ndjson"):
        return flatten(spark.read.json(path))
    raise ValueError(f"no reader for {path}")


def as_strings(df: DataFrame) -> DataFrame:
    """All columns as text, as a reader without types gives them."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A csv or parquet table as text; words like NA stay text."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return as_strings(spark.read.parquet(path))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, at: tuple[str, ...] = ()):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*at, f.name))
            else:
                yield (*at, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema)])


def profile(df: DataFrame) -> DataFrame:
    """column_name, data_type, n_rows, n_missing of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("_n").cast("long").alias("n_rows"), F.col(f"_m{i}").cast("long").alias("n_missing")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and sha256 of files, hashed where they are read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return d.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size and sha256 of the members of zip archives; an archive is read by one task."""

    def read(batches):
        import hashlib
        import io
        import zipfile

        import pandas as pd

        for frame in batches:
            rows = []
            for where, body in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    rows += [(where, i.filename, i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size", "sha256"])

    d = spark.read.format("binaryFile").load(path).select("path", "content")
    return d.mapInPandas(read, "archive string, name string, size long, sha256 string")


def write_store(df: DataFrame, path: str, order: str) -> None:
    """Parquet with zstd, sorted within the files."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """response_id and probability as CSV with a header."""
    df.select("response_id", "probability").orderBy("response_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, value: dict) -> None:
    """A report of bounded size: sorted keys, two spaces."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
