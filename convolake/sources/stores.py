"""Stores with manifests: discovery, reuse, installation, sparse parts, vectors, archives."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.operators.relational import duplicate_keys
from convolake.sources.tables import file_hashes


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, whether a folder, bytes) of what lies directly in a folder of any file system, by name."""
    p, fs = _path(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))


def discover_files(spark: SparkSession, path: str) -> tuple[list[str], dict[str, int]]:
    """Files directly in a folder, and the number of files below each of its folders."""
    found = list_folder(spark, path)
    counts = {}
    for name, folder, _ in found:
        if folder:
            p, fs = _path(spark, f"{path}/{name}")
            counts[name] = int(fs.getContentSummary(p).getFileCount())
    return [n for n, folder, _ in found if not folder], counts


def discover_sources(spark: SparkSession, path: str) -> dict[str, str | None]:
    """features, labels, transcripts and archive of a raw folder; each but the archive has to be there once."""
    found = list_folder(spark, path)
    tables = (".csv", ".parquet")
    kinds = {
        "features": [n for n, d, _ in found if not d and n.startswith("train_features") and n.endswith(tables)],
        "labels": [n for n, d, _ in found if not d and n.startswith("train_labels") and n.endswith(tables)],
        "transcripts": [n for n, d, _ in found if d and "transcript" in n.lower()],
        "archive": [n for n, d, _ in found if not d and n.endswith(".zip")],
    }
    for kind, names in kinds.items():
        if len(names) > 1 or (not names and kind != "archive"):
            raise ValueError(f"{len(names)} candidates for {kind}: {names}")
    stems = [n.rsplit(".", 1)[0].lower() for n, d, _ in list_folder(spark, f"{path}/{kinds['transcripts'][0]}") if not d and n.endswith(".csv")]
    if len(set(stems)) != len(stems):
        raise ValueError("transcripts whose names differ in case alone")
    return {k: f"{path}/{v[0]}" if v else None for k, v in kinds.items()}


# ---- manifests -------------------------------------------------------------------------------


def digest(value: object) -> str:
    """SHA-256 of a JSON value with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def tree_digest(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """One hash of the names, sizes and contents of all files below a folder; files are hashed where they are read."""
    d = file_hashes(spark, path, pattern).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"), "size", "sha256")
    return hashlib.sha256(d.select(F.sha2(F.concat_ws("\x00", "n", F.col("size").cast("string"), "sha256").cast("binary"), 256).alias("h")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("h")).first()[0].encode()).hexdigest()  # 64 characters a file


def _text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def manifest_of(spark: SparkSession, store: str) -> dict | None:
    """The manifest beside a store, if its output is still what it says."""
    raw = _text(spark, f"{store}.manifest.json")
    if raw is None:
        return None
    found = json.loads(raw)
    p, fs = _path(spark, store)
    if not fs.exists(p) or tree_digest(spark, store, "*.parquet") != found.get("output"):
        return None
    return found


def build_store(spark: SparkSession, store: str, make, *, version: str, sources: dict[str, str], schema: T.StructType | None = None, order: str | None = None) -> str:
    """Writes make() as Parquet with a manifest, unless the manifest of the same version and sources still holds: "built" or "reused".

    The table is written beside the store and renamed into place; if that fails, what was there before comes back.
    """
    key = digest({"version": version, "sources": sources})
    before = manifest_of(spark, store)
    if before is not None and before["key"] == key:
        return "reused"
    df = make()
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"the store's columns are {df.schema.simpleString()}")
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    fresh = f"{store}.new-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(fresh)
    made = {"key": key, "version": version, "sources": sources, "columns": df.schema.simpleString(), "rows": spark.read.parquet(fresh).count(), "output": tree_digest(spark, fresh, "*.parquet")}
    install(spark, fresh, store)
    _put(spark, f"{store}.manifest.json", json.dumps(made, indent=2, sort_keys=True))
    return "built"


def install(spark: SparkSession, fresh: str, place: str) -> None:
    """Renames a folder into place; the one before it is put aside, and comes back if the second step fails."""
    (new, fs), (old, _), (aside, _) = _path(spark, fresh), _path(spark, place), _path(spark, f"{place}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{place} can't be moved")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{fresh} can't be moved to {place}")
    if had:
        fs.delete(aside, True)


# ---- sparse parts and vectors ----------------------------------------------------------------


def sparse_faults(rows: DataFrame, ids: DataFrame, width: int) -> dict[str, int]:
    """What a sparse store (row_id, bucket, value) breaks: rows that are missing, unknown, repeated cells, cells out of range or not finite."""
    v = F.col("value")
    one = rows.agg(F.count_if((F.col("bucket") < 0) | (F.col("bucket") >= width)).alias("out_of_range"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite")).first()
    return {
        "missing": ids.join(rows.select("row_id").distinct(), "row_id", "left_anti").count(),
        "unknown": rows.select("row_id").distinct().join(ids, "row_id", "left_anti").count(),
        "repeated": duplicate_keys(rows, "row_id", "bucket").count(),
        "out_of_range": one[0],
        "not_finite": one[1],
    }


def read_sparse(spark: SparkSession, path: str, ids: DataFrame, width: int) -> DataFrame:
    """A sparse store that covers all ids; anything else fails."""
    rows = spark.read.parquet(path)
    faults = {k: n for k, n in sparse_faults(rows, ids, width).items() if n}
    if faults:
        raise ValueError(f"sparse store: {faults}")
    return rows


def vector_faults(df: DataFrame, key: str, vector: str, width: int) -> dict[str, int]:
    """What a store of unit vectors breaks: width, finite values, norms off 1 by over 1e-5, repeated keys."""
    v = F.col(vector)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bad = v.isNull() | (F.size(v) != width)
    one = df.agg(F.count_if(bad).alias("width"), F.count_if(~bad & F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"), F.count_if(~bad & (F.abs(F.sqrt(square) - 1) > 1e-5)).alias("norm")).first()
    return {"width": one[0], "not_finite": one[1], "norm": one[2], "repeated": duplicate_keys(df, key).count()}


def read_vectors(spark: SparkSession, path: str, key: str, vector: str, width: int) -> DataFrame:
    df = spark.read.parquet(path)
    faults = {k: n for k, n in vector_faults(df, key, vector, width).items() if n}
    if faults:
        raise ValueError(f"vector store: {faults}")
    return df


# ---- archives and fixtures -------------------------------------------------------------------


def write_zip(path: str, members: dict[str, bytes]) -> str:
    """A local archive of a bounded bundle that is the same, byte by byte, for the same members; its SHA-256."""
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"unsafe name {name}")
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, members[name])
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def smoke_fixture(wanted: DataFrame, features: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of the wanted responses, lines of their sessions); a response that is unknown or listed twice fails."""
    from convolake.operators.relational import one_to_one

    own = one_to_one(wanted.select("response_id"), features, "response_id", "left")
    if own.where("session_id is null").limit(1).count():
        raise ValueError("a response has no features")
    return own, transcripts.join(own.select("session_id").distinct(), "session_id", "left_semi")
