"""Inference end to end: a test folder in, a checked prediction table out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions.lexicon import STOPWORDS, Budgets, Lexicon
from convolake.operators import action_graph as G
from convolake.operators import dense as D
from convolake.operators import evidence as V
from convolake.operators import relational as R
from convolake.operators import sessions as C
from convolake.plans import modeling as M
from convolake.sources import tables as T


@dataclass(frozen=True)
class Bundle:
    """What inference needs: heads (model, feature column, weight), the calibration of the first, and the limits of extraction."""

    heads: tuple[tuple[object, str, float], ...]
    calibration: tuple[float, float] = (1.0, 0.0)
    budgets: Budgets = Budgets()
    lexicon: Lexicon = Lexicon()


def check_bundle(bundle: Bundle, widths: dict[str, int]) -> None:
    """Fails unless weights sum to 1, the slope is positive and each head has as many coefficients as its column has features."""
    if abs(sum(w for _, _, w in bundle.heads) - 1) > 1e-9 or any(w < 0 for _, _, w in bundle.heads):
        raise ValueError("weights")
    if not bundle.calibration[0] > 0:
        raise ValueError("slope")
    for model, column, _ in bundle.heads:
        if model.numFeatures != widths[column]:
            raise ValueError(f"{column}: {model.numFeatures} coefficients for {widths[column]} features")


def response_views(transcripts: DataFrame, responses: DataFrame, budgets: Budgets = Budgets(), lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Every response with its ten texts, 81 dense and 14 graph features; the same for training and inference.

    responses: session_id, objective_id, objective. Session features are made once a session and joined.
    A response whose session has no line is kept, with empty texts and zeros.
    """
    keys = list(V.RESPONSE)
    responses = responses.select(*keys, "objective")
    lines = C.ordered_lines(transcripts, lexicon)
    s = V.scored(lines, responses)
    texts = V.response_texts(s, C.session_views(transcripts), budgets).drop("learning_objective")
    dense = D.dense_features(s, lines, budgets)
    graph = G.response_graph(lines, G.labelled(lines, lexicon), responses, STOPWORDS)
    d = responses.join(texts, keys, "left").join(dense, keys, "left").join(graph, keys, "left")
    return d.select(*[F.coalesce(F.col(c), F.lit("") if t == "string" else F.lit(0.0)).alias(c) if c not in keys else F.col(c) for c, t in d.dtypes])


def dense_column(views: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """response keys and `dense`, the numeric features in the order of their names."""
    names = sorted(c for c, t in views.dtypes if t == "double" and (not prefixes or c.startswith(prefixes)))
    return views.withColumn("dense", F.array(*[F.col(c) for c in names]))


def runtime_rows(spark: SparkSession, folder: str, bundle: Bundle) -> tuple[DataFrame, DataFrame]:
    """(expected ids in order, views of all test responses) of a folder with the format, features and transcripts; faults fail."""
    expected = spark.read.option("header", True).csv(f"{folder}/submission_format.csv").select("response_id")
    features = T.read_csv(spark, f"{folder}/test_features.csv", T.RESPONSES)
    transcripts = T.read_transcripts(spark, f"{folder}/test_transcripts")
    if R.key_difference(expected, features, "response_id").limit(1).count() or R.duplicate_keys(features, "response_id").limit(1).count():
        raise ValueError("the format's and the features' ids differ")
    if T.transcript_faults(transcripts).limit(1).count():
        raise ValueError("a transcript breaks its contract")
    if R.missing_sessions(features, transcripts.select(F.col("_stem").alias("stem")).distinct()).limit(1).count():
        raise ValueError("a session has no transcript")
    responses = features.select("response_id", "session_id", F.col("learning_objective_id").alias("objective_id"), F.col("learning_objective").alias("objective"))
    views = response_views(transcripts.drop("_stem"), responses.select("session_id", "objective_id", "objective").distinct(), bundle.budgets, bundle.lexicon)
    return expected, responses.select("response_id", "session_id", "objective_id").join(views, ["session_id", "objective_id"])


def predict_folder(spark: SparkSession, folder: str, bundle: Bundle) -> DataFrame:
    """response_id, probability of every id of the format, in its order; fails if the contract is broken."""
    expected, views = runtime_rows(spark, folder, bundle)
    d = dense_column(views)
    width = len(d.select("dense").first()[0])
    check_bundle(bundle, {column: width for _, column, _ in bundle.heads})
    return in_order(M.predict(d, list(bundle.heads), bundle.calibration), expected)


def in_order(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """The predictions in the order of the expected ids, checked: schema, ids once each, probabilities within 0 and 1."""
    if predictions.dtypes != [("response_id", dict(expected.dtypes)["response_id"]), ("probability", "double")]:
        raise ValueError(f"columns are {predictions.dtypes}")
    faults = M.contract_faults(predictions, expected).first().asDict()
    if any(faults.values()):
        raise ValueError(f"prediction contract: {faults}")
    place = expected.select("response_id", F.monotonically_increasing_id().alias("_place"))
    return place.join(predictions, "response_id").orderBy("_place").select("response_id", "probability")
