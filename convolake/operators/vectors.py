"""Hashed n-grams, norms, scalers and embedding interactions."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.text import let


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters without: one character each, by their canonical decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), *_plain_letters())


def words2(text: Column) -> Column:
    """Words of two characters or more, lower-cased, without accents."""
    return F.regexp_extract_all(plain(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def interactions(c: Column, o: Column, dense: Column | None = None) -> Column:
    """[c, o, |c - o|, c o, cosine, dense] of unit vectors: 4 d + 1 + k values."""
    parts = [c, o, F.zip_with(c, o, lambda x, y: F.abs(x - y)), F.zip_with(c, o, lambda x, y: x * y), F.array(dot(c, o))]
    return F.concat(*parts, *([] if dense is None else [F.transform(dense, lambda x: x.cast("double"))]))


def bucket(gram: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("long") % n


def hashed_ngrams(df: DataFrame, key: str, toks: Column, n: int) -> DataFrame:
    """key, bucket, value: counts of word 1- and 2-grams, hashed and scaled to unit length, as sparse rows."""
    d = df.select(key, toks.alias("_t"))
    pairs = F.when(F.size("_t") > 1, F.transform(F.sequence(F.lit(0), F.size("_t") - 2), lambda i: F.concat_ws(" ", F.get("_t", i), F.get("_t", i + 1))))
    d = d.select(key, F.explode(F.concat("_t", F.coalesce(pairs, F.expr("cast(array() as array<string>)")))).alias("g"))
    d = d.groupBy(key, bucket(F.col("g"), n).alias("bucket")).agg(F.count("*").cast("double").alias("c"))
    norms = d.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return d.join(norms, key).select(key, "bucket", (F.col("c") / F.col("norm")).alias("value"))


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by population deviation, over the root of the width; a constant column is only centred."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("s")).alias(f"_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(stats))  # one row
    return d.select(*[x for x in df.columns if x not in columns], *[((F.col(c) - F.col(f"_{c}.m")) / F.col(f"_{c}.s") / float(len(columns)) ** 0.5).alias(c) for c in columns])


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One assignment and update: cluster of each point by squared distance, ties to the lower cluster; then sizes and means by dimension."""
    c = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("_cs")))  # k rows
    near = F.array_min(F.transform("_cs", lambda s: F.struct(F.aggregate(F.zip_with("embedding", s["centre"], lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x).alias("d"), s["cluster"].alias("cluster"))))
    a = points.crossJoin(c).select("vec_id", near["cluster"].alias("cluster"), "embedding")
    return a.select("cluster", F.posexplode("embedding").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").cast("long").alias("n"))


def hashed_spaces(texts: DataFrame, key: str, sizes: dict[str, int], offset: int = 0) -> DataFrame:
    """key, bucket, value: unit n-gram vectors of several text columns, each in a range of buckets of its own."""
    out = None
    for name, n in sizes.items():
        part = hashed_ngrams(texts.select(key, name), key, words2(F.col(name)), n).withColumn("bucket", F.col("bucket") + offset)
        out = part if out is None else out.unionByName(part)
        offset += n
    return out


def response_hashes(responses: DataFrame, views: DataFrame, objectives: DataFrame, sizes: dict[str, int], objective_size: int) -> DataFrame:
    """session_id, objective_id, bucket, value: the texts of each response's session and its objective side by side.

    Every session and every objective is hashed once, then joined to its responses.
    """
    pairs = responses.select("session_id", "objective_id")
    session = hashed_spaces(views, "session_id", sizes)
    objective = hashed_spaces(objectives.select("objective_id", "objective"), "objective_id", {"objective": objective_size}, sum(sizes.values()))
    names = ["session_id", "objective_id", "bucket", "value"]
    return pairs.join(session, "session_id").select(names).unionByName(pairs.join(objective, "objective_id").select(names))


def append_dense(sparse: DataFrame, dense: DataFrame, keys: list[str], columns: list[str], width: int) -> DataFrame:
    """Sparse rows with scaled dense columns behind them, in buckets from width on; a table without the same keys fails."""
    scaled = scale(dense.select(*keys, *columns), columns)
    tail = scaled.select(*keys, F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_i", "value")).select(*keys, (F.col("_i") + width).cast("long").alias("bucket"), "value")
    lacking = sparse.select(*keys).distinct().join(dense.select(*keys), keys, "left_anti").limit(1).count() + dense.select(*keys).join(sparse.select(*keys), keys, "left_anti").limit(1).count()
    if lacking:
        raise ValueError("text and dense rows differ")
    return sparse.select(*keys, "bucket", "value").unionByName(tail.where("value <> 0"))


def encode_once(df: DataFrame, key: str, text: str, encoder, width: int) -> DataFrame:
    """key, vector: encoder(list of texts) -> rows x width, applied once to each distinct key and text in Arrow batches; unit vectors.

    A key with several texts fails, and so does a vector that is zero or not finite.
    """
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        v = np.asarray(encoder(texts.tolist()), float).reshape(len(texts), width)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if not np.isfinite(v).all() or not (norm > 0).all():
            raise ValueError("an encoder's vector is zero or not finite")
        return pd.Series(list((v / norm).astype(np.float32)))

    distinct = df.select(key, text).distinct()
    twice = distinct.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"a {key} has several texts")
    return distinct.select(key, run(F.col(text)).alias("vector"))


def hashing_encoder(width: int = 64):
    """A deterministic encoder without weights: counts of hashed words."""

    def encode(texts: list[str]):
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()) or [""]:
                out[i, zlib.crc32(w.encode()) % width] += 1
        return out

    return encode
