"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the centred vectors is learned, by alternating binary codes and an orthogonal
Procrustes step, on a bounded sample (`sample_rows` vectors, the first by a hash of the id), so that
the signs of the rotated vectors are balanced codes of up to 64 bits. Every vector is indexed in one
table per substring of its code; a search looks up its own substring and all within `radius` bits.
The layout (four tables, radius 1) is the same at every size, a parameter beyond.
A pair is kept at the first table that finds it, if its codes are close enough, and is reranked with
the original vectors in double precision; only pairs of cosine >= threshold link.

The search is approximate: linked vectors whose codes differ in more than `radius` bits of every
substring are not found. With `exact`, candidates come from a grid instead: linked unit vectors are at
most sqrt(2 - 2 threshold) apart, so on the first principal axes they lie in the same or in
neighbouring cells of that width; every link is found, at the price of more candidates.

Equal vectors are one node with a count, so a vector that is very common costs no pairs. What is
broadcast is the rotation (64 x 64) and nothing that grows: joins are by sorting, as the size of a table's files says
little of its size in the driver's memory, and no more than the sample reaches the driver.

Defined results: a vector that is null, zero, of null or non-finite components, or of another length
than most vectors, links with nothing and keeps itself; repeated rows are other vectors, linked; an empty table gives
an empty result; other columns are ignored. A null id gets a null component. Ids are expected to belong
to one vector each; where one has several, its rows get the most links and the smallest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.llm.common import connected_components, materialize
from convolake.llm.kernels import mix


#: Principal axes of the exact search's grid.
GRID_AXES = 4


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are the code."""
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[:bits].T
    v = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


def tables_for(bits: int, tables: int) -> list[tuple[int, int]]:
    """(shift, width) of each table's substring of the code."""
    edges = np.linspace(0, bits, tables + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def probes(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def hashed_first(v: DataFrame, total: int, n: int) -> DataFrame:
    """Rows of v, of total rows, that hold the first n by the hash of the id and few more, so that no task sends n of its own."""
    share = (n + 8 * n**0.5 + 64) / max(total, 1)
    return v if share >= 1 else v.where(F.xxhash64("vec_id") <= F.lit(int(share * 2**64) - 2**63))


def near_links(vectors: DataFrame, *, threshold: float = 0.95, sample_rows: int = 20_000, most_bits: int = 24, tables: int = 4, radius: int = 1, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): vec_id, rep, copies of each good row; and a, b, cosine of linked representatives, a < b.

    exact: candidates come from a grid instead of the tables, and no link is lost.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    sizes = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, total = sizes[0] if sizes else (1, 0)
    v = v.where(F.size("embedding") == dim)
    bits = min(64, dim)
    first = hashed_first(v, total, sample_rows).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow()
    if total and not first.num_rows:  # few ids, of many rows each
        first = v.select("embedding").limit(sample_rows).toArrow()
    if first.num_rows:
        x = first["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        scale = np.abs(x).max(1, keepdims=True)
        x = x / scale
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        mean, projection = learn_rotation(x, bits)
        axes = np.linalg.svd(np.cov(x.T).reshape(dim, dim))[0][:, :GRID_AXES] if len(x) > 1 else np.eye(dim)[:, :GRID_AXES]
    else:
        mean, projection, axes = np.zeros(dim), np.zeros((dim, bits)), np.eye(dim)[:, :GRID_AXES]
    width = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6

    def cells(unit: np.ndarray) -> list[pa.Array]:
        at = np.floor(unit @ axes / width).astype(np.int64)
        at = np.concatenate([at, np.zeros((len(at), GRID_AXES - at.shape[1]), np.int64)], 1)
        return [pa.array(np.ascontiguousarray(at[:, i])) for i in range(GRID_AXES)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim) + 0.0  # -0.0 becomes 0.0
            raw = np.ascontiguousarray(x).view(np.uint64)
            at = np.arange(1, dim + 1, dtype=np.uint64)
            signs = [mix(mix(raw + at * np.uint64(k)).sum(1, dtype=np.uint64)).view(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            unit = x / np.abs(x).max(1, keepdims=True)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            code = ((unit - mean) @ projection >= 0) @ (np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s) for s in signs], pa.array(code.astype(np.uint64).view(np.int64)), *cells(unit), pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), dim).cast(pa.list_(pa.float64()))], names=schema.names)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("vec_id", "s1", "s2", "code", *(f"g{i}" for i in range(GRID_AXES)))] + [T.StructField("unit", T.ArrayType(T.DoubleType()))])
    rows = materialize(v.mapInArrow(coded, schema), "codes")
    groups = rows.groupBy("s1", "s2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("code").alias("code"), *[F.first(f"g{i}").alias(f"g{i}") for i in range(GRID_AXES)])
    groups = materialize(groups, "groups")
    nodes = rows.select("vec_id", "s1", "s2").join(groups.select("s1", "s2", "rep", "copies").hint("merge"), ["s1", "s2"]).select("vec_id", "rep", "copies")

    tables = tables_for(bits, tables)
    own = lambda code, shift, width: F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))
    index = groups.select("rep", "code", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), own(F.col("code"), *part).alias("key")) for t, part in enumerate(tables)])).alias("at")).select(F.col("rep").alias("b"), F.col("code").alias("cb"), "at.*")
    probe = groups.select("rep", "code", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), own(F.col("code"), *part).alias("sub"), F.array(*[F.lit(p).cast("long") for p in probes(part[1], radius)]).alias("flips")) for t, part in enumerate(tables)])).alias("at"))
    probe = probe.select(F.col("rep").alias("a"), F.col("code").alias("ca"), "at.t", "at.sub", F.explode("at.flips").alias("flip")).select("a", "ca", "t", F.col("sub").bitwiseXOR(F.col("flip")).alias("key"))
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    earlier = F.lit(True)
    for t, part in enumerate(tables):  # an earlier table has found the pair already
        earlier = earlier & ((F.col("p.t") <= t) | (F.bit_count(own(differ, *part)) > radius))
    pairs = probe.alias("p").join(index.alias("i").hint("merge"), (F.col("p.t") == F.col("i.t")) & (F.col("p.key") == F.col("i.key")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= most_bits) & earlier).select("a", "b")

    if exact:
        names = [f"g{i}" for i in range(GRID_AXES)]
        around = groups.select(F.col("rep").alias("a"), *names)
        for name in names:  # 3 ** GRID_AXES cells a vector
            around = around.withColumn(name, F.explode(F.array(*[F.col(name) + i for i in (-1, 0, 1)])))
        pairs = around.join(groups.select(F.col("rep").alias("b"), *names).hint("merge"), names).where("a < b").select("a", "b")

    reps = rows.join(groups.select(F.col("rep").alias("vec_id")).hint("merge"), "vec_id", "left_semi").dropDuplicates(["vec_id"]).select("vec_id", "unit")
    reps = materialize(reps, "units")
    both = pairs.join(reps.select(F.col("vec_id").alias("a"), F.col("unit").alias("ua")).hint("merge"), "a").join(reps.select(F.col("vec_id").alias("b"), F.col("unit").alias("ub")).hint("merge"), "b")

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y)
            keep = np.flatnonzero(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(cosine[keep])], names=["a", "b", "cosine"])

    links = both.select("a", "b", "ua", "ub").mapInArrow(reranked, "a long, b long, cosine double")
    return materialize(nodes, "nodes"), materialize(links, "links")


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    nodes, links = near_links(vectors, **options)
    reps = nodes.where("vec_id = rep").dropDuplicates(["rep"]).select("rep", "copies")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a")))
    many = ends.join(reps.select(F.col("rep").alias("other"), "copies").hint("merge"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    comp = connected_components(links.select("a", "b"), "near", hint="merge")
    per = reps.join(many.hint("merge"), "rep", "left").join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    known = nodes.join(per.hint("merge"), "rep").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id"), F.size("embedding").alias("_size"), F.col("embedding").cast("array<double>").alias("_e"))
    good = F.coalesce(F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_e", lambda x: x != 0), F.lit(False))
    out = out.select("vec_id", good.alias("_good")).join(known.withColumnRenamed("vec_id", "_id").hint("merge"), F.col("vec_id") == F.col("_id"), "left")
    n = F.when(F.col("_good"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    component = F.when(F.col("_good"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
