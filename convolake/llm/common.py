"""Helpers shared by the corpus operators: shared-folder tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`, the words of the corpus contracts, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a session in one process gets a folder of its own; a cluster fails."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='convolake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage.

    The table survives lost executors, and several consumers read it with their own column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` whose readers have all been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most so many rows, so that buffers on both sides stay a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def let(value: Column, body) -> Column:
    """Binds value to a name, so that body evaluates it once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60, hint: str | None = None) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    edges: columns a, b (long), in any direction. Returns node, component. Alternates large-star and
    small-star steps; each round is two group-by-minimum and join passes over the edge table, which
    is written to the shared folder, and shrinks the diameter of every component geometrically.
    Only two numbers per round reach the driver. A node with very many edges is a hot join key on one
    side only, which AQE splits; its minimum is pre-aggregated before the shuffle. A hint of `merge` keeps Spark
    from broadcasting minima.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = materialize(e, name)
    hinted = lambda d: d.hint(hint) if hint else d
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(hinted(m), "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        m2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(hinted(m2), "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("p")).select("p.*").where("lo < hi").distinct()
        before_e, e = e, materialize(small, name)
        release(before_e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
