"""Cross-validated linear heads, families of objectives and prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import evaluation as E


def fit_head(df: DataFrame, features: str, y: str, reg: float = 1e-4, iterations: int = 30):
    """Ridge logistic regression on an array column."""
    d = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("_x"), F.col(y).cast("double").alias("_y"))
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(d)


def apply_head(model, df: DataFrame, features: str, name: str) -> DataFrame:
    d = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    d = model.setPredictionCol("_pred").setRawPredictionCol("_raw").setProbabilityCol("_prob").transform(d)
    return d.withColumn(name, vector_to_array("_prob")[1]).drop("_x", "_pred", "_raw", "_prob")


def training_rows(split: DataFrame, k: int) -> DataFrame:
    """The training rows of a fold; none left after the purge fails."""
    train = split.where("split = 'train'")
    if not train.limit(1).count():
        raise ValueError(f"fold {k} has no training rows")
    return train


def out_of_fold(df: DataFrame, features: str, y: str, group: str, session: str, n: int = 3, seed: int = 0) -> DataFrame:
    """Predictions of every row by the model that saw neither its group nor its session."""
    folds = E.snake_folds(df, group, y, n, seed)
    out = None
    for k in range(n):
        d = E.splits(df, folds, group, session, k)
        model = fit_head(training_rows(d, k), features, y)
        part = apply_head(model, d.where("split = 'validation'"), features, "probability").drop("split")
        out = part if out is None else out.unionByName(part)
    return out


def fit_platt(df: DataFrame, p: str, y: str) -> tuple[float, float]:
    """Slope and offset of calibration by maximum likelihood."""
    model = fit_head(df.select(F.array(E.logit(F.col(p))).alias("_f"), y), "_f", y, reg=1e-9, iterations=100)
    return float(model.coefficients[0]), float(model.intercept)


def families(points: DataFrame, k: int, seed: int, starts: int = 1) -> DataFrame:
    """vec_id, family: k-means clusters, the best of several starts, numbered by the order of their centres."""
    d = points.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("_x")).orderBy("vec_id")
    models = [KMeans(featuresCol="_x", predictionCol="_c", k=k, seed=seed + i, maxIter=50).fit(d) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    rank = {old: new for new, (_, old) in enumerate(sorted((list(map(float, c)), i) for i, c in enumerate(model.clusterCenters())))}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]), F.col("_c"))
    return model.transform(d).select("vec_id", number.cast("int").alias("family"))


def predict(features: DataFrame, heads: list[tuple[object, str, float]], calibration: tuple[float, float] = (1.0, 0.0), key: str = "response_id") -> DataFrame:
    """Blend of heads (model, feature column, weight), the first calibrated; row by row."""
    d = features
    for i, (model, column, _) in enumerate(heads):
        d = apply_head(model, d, column, f"_p{i}")
    parts = [(E.platt(F.col("_p0"), *calibration), heads[0][2])] + [(F.col(f"_p{i}"), w) for i, (_, _, w) in enumerate(heads) if i]
    return d.select(key, E.blend(parts).alias("probability"))


def contract_faults(predictions: DataFrame, expected: DataFrame, key: str = "response_id") -> DataFrame:
    """Counts of what a prediction table breaks: missing, unknown or repeated ids, values that are no probability."""
    p = F.col("probability")
    bad = predictions.agg(F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).cast("long").alias("bad_values"), (F.count("*") - F.countDistinct(key)).cast("long").alias("repeated"))
    missing = expected.join(predictions, key, "left_anti").agg(F.count("*").cast("long").alias("missing"))
    unknown = predictions.join(expected, key, "left_anti").agg(F.count("*").cast("long").alias("unknown"))
    return bad.crossJoin(missing).crossJoin(unknown)  # one row each


def dispersion(by_fold: DataFrame, metric: str) -> DataFrame:
    return by_fold.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.max(metric).alias("worst"))


def nested_platt(df: DataFrame, folds: DataFrame, group: str, session: str, p: str, y: str, n: int) -> DataFrame:
    """df with fold and calibrated: each fold's rows by a calibration fitted on its own purged training rows."""
    out = None
    for k in range(n):
        d = E.splits(df, folds, group, session, k)
        train = training_rows(d, k)
        if train.select(y).distinct().limit(2).count() < 2:
            raise ValueError(f"fold {k} lacks a class to calibrate on")
        a, b = fit_platt(train, p, y)
        part = d.where("split = 'validation'").withColumn("calibrated", E.platt(F.col(p), a, b)).drop("split")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class SemanticScaler:
    """Leaves the first `prefix` values alone; the dense tail becomes z-scores over the root of its width."""

    prefix: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, v: Column) -> Column:
        root = float(len(self.mean)) ** 0.5
        tail = [(F.get(v, F.lit(self.prefix + i)) - m) / (s * root) for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))]
        return F.concat(F.slice(v, 1, self.prefix), F.array(*tail)) if tail else v


def fit_semantic_scaler(df: DataFrame, features: str, prefix: int, width: int) -> SemanticScaler:
    """Population means and deviations of the tail, in one pass; a constant column is only centred."""
    aggs = [x for i in range(prefix, width) for x in (F.avg(F.get(features, F.lit(i))), F.stddev_pop(F.get(features, F.lit(i))))]
    got = df.agg(*aggs).first() if aggs else ()
    return SemanticScaler(prefix, tuple(float(x) for x in got[::2]), tuple(float(x) or 1.0 for x in got[1::2]))


def fit_semantic_head(df: DataFrame, features: str, y: str, prefix: int, width: int, c: float = 0.1):
    """(scaler, model): a ridge head on interactions as they are and a scaled dense tail; c is the inverse of the penalty a row."""
    scaler = fit_semantic_scaler(df, features, prefix, width)
    d = df.select(scaler.apply(F.col(features)).alias("_f"), y)
    return scaler, fit_head(d, "_f", y, reg=1.0 / (c * max(1, d.count())), iterations=100)


def semantic_out_of_fold(df: DataFrame, features: str, y: str, group: str, session: str, prefix: int, width: int, n: int = 3, c: float = 0.1, seed: int = 0) -> DataFrame:
    """Predictions of every row by scaler and head that saw neither its group nor its session."""
    folds, out = E.snake_folds(df, group, y, n, seed), None
    for k in range(n):
        d = E.splits(df, folds, group, session, k)
        scaler, model = fit_semantic_head(training_rows(d, k), features, y, prefix, width, c)
        part = apply_head(model, d.where("split = 'validation'").withColumn("_f", scaler.apply(F.col(features))), "_f", "probability").drop("split", "_f")
        out = part if out is None else out.unionByName(part)
    return out


def gate(losses: DataFrame, ensemble: str, others: list[str]) -> DataFrame:
    """passed, worst_protocol and its loss: the ensemble has to beat each of the others in every protocol; losses: protocol and a column each."""
    return losses.agg(F.bool_and(F.col(ensemble) < F.least(*others) if len(others) > 1 else F.col(ensemble) < F.col(others[0])).alias("passed"), F.max_by("protocol", ensemble).alias("worst_protocol"), F.max(ensemble).alias("worst_loss"))


def ablation(metrics: DataFrame, metric: str) -> DataFrame:
    """protocol, delta: a metric with a block of features less the metric without; metrics: protocol, with_block, metric."""
    d = metrics.groupBy("protocol").agg(F.max(F.when(F.col("with_block"), F.col(metric))).alias("a"), F.max(F.when(~F.col("with_block"), F.col(metric))).alias("b"))
    return d.select("protocol", (F.col("a") - F.col("b")).alias("delta"))
