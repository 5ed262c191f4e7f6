"""Spark ML classifiers over flow features and window summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from flowlens.functions.cleaning import is_attack
from flowlens.functions.ordering import hash_key, key_slice, sliced_row_number
from flowlens.operators.sequences import session_windows
from flowlens.schema import BENIGN, SEQUENCE_FEATURES, SESSION_KEY, WINDOW_SIZE, WINDOW_STRIDE
from flowlens.session import materialize, use_checkpoints

# Class-weight rule and positive weights.
WEIGHT_GAIN, WEIGHT_CAP = 1.5, 10.0
FLOW_POSITIVE_WEIGHT = 50.0
SEQUENCE_POSITIVE_WEIGHT = 18.0
SCORING_BATCH = 2048


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``min(sqrt(max / n) * 1.5, 10)`` per class, Benign 1. One row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy())
    dampened = F.least(F.sqrt(top / F.col("n")) * WEIGHT_GAIN, F.lit(WEIGHT_CAP))
    return counts.withColumn("weight", F.when(F.col(label) == BENIGN, 1.0).otherwise(dampened))


def label_encoding(df: DataFrame, label: str = "label") -> DataFrame:
    """0-based index of each distinct label in sorted order. One row per class."""
    names = df.select(label).distinct()
    return names.withColumn("label_idx", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def encode_known(df: DataFrame, encoder: DataFrame, label: str = "label") -> DataFrame:
    """Attach ``label_idx``; rows with a label the encoder never saw are dropped."""
    return df.join(encoder, label)


def with_positive_weight(df: DataFrame, weight: float, label: str = "label") -> DataFrame:
    y = is_attack(label).cast("double")
    return df.withColumn("y", y).withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0))


def _zeros(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def fit_binary(
    flows: DataFrame, features: Sequence[str], weight: float = FLOW_POSITIVE_WEIGHT,
    rounds: int = 100, depth: int = 8, step: float = 0.05,
) -> PipelineModel:
    """Boosted trees on attack against Benign."""
    use_checkpoints(flows.sparkSession)
    trees = GBTClassifier(
        labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42,
        checkpointInterval=10,
    )
    rows = with_positive_weight(_zeros(flows, features), weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees]).fit(rows)


def fit_binary_early_stop(
    flows: DataFrame, features: Sequence[str], eval_flag: str, weight: float = FLOW_POSITIVE_WEIGHT,
    rounds: int = 100, depth: int = 8, step: float = 0.05, tolerance: float = 0.01,
) -> PipelineModel:
    """As :func:`fit_binary`, stopping when the held-out loss stops improving."""
    use_checkpoints(flows.sparkSession)
    trees = GBTClassifier(
        labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42,
        validationIndicatorCol=eval_flag, validationTol=tolerance, checkpointInterval=10,
    )
    rows = with_positive_weight(_zeros(flows, features), weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees]).fit(rows)


def score_binary(model: PipelineModel, flows: DataFrame, features: Sequence[str], out: str = "x_score") -> DataFrame:
    """Probability of attack as column ``out``."""
    scored = model.transform(_zeros(flows, features).withColumn("y", is_attack().cast("double")))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "y")


def log_loss(scored: DataFrame, score: str = "x_score", by: Sequence[str] = ()) -> DataFrame:
    """Mean binary log-loss and accuracy, optionally per group."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = is_attack()
    loss = -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("log_loss"),
        F.avg(((p > 0.5).cast("int") == y).cast("double")).alias("accuracy"),
    )


def fit_multiclass(
    features_df: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 10,
) -> tuple[PipelineModel, list[str]]:
    """Weighted random forest over all labels; returns the model and its class order.

    The class order is alphabetical. Weights are joined back by label, one row
    per class.
    """
    weighted = _zeros(features_df, features).join(
        class_weights(features_df).select("label", F.col("weight").alias("w")), "label"
    )
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(
            labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, subsamplingRate=0.8,
            featureSubsetStrategy="auto", seed=42,
        ),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    return model, list(model.stages[0].labels)


def score_multiclass(
    model: PipelineModel, labels: Sequence[str], df: DataFrame, features: Sequence[str]
) -> DataFrame:
    """``pred_label``, class ``probs`` and ``x_score`` = 1 - P(Benign); unseen labels are dropped."""
    scored = model.transform(_zeros(df, features))
    names = F.array(*[F.lit(x) for x in labels])
    return scored.withColumn("probs", vector_to_array("probability")).withColumn(
        "pred_label", names[F.col("prediction").cast("int")]
    ).withColumn("x_score", 1 - F.col("probs")[list(labels).index(BENIGN)]).drop(
        "features", "rawPrediction", "probability", "prediction", "y"
    )


def feature_importances(model: PipelineModel, features: Sequence[str], k: int = 15) -> DataFrame:
    """The k most important features of a tree model, most important first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(k)


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], ids: Sequence[str], seed: int = 42
) -> DataFrame:
    """Loss added when one feature takes another row's value.

    Rows are ranked by their id order and by a hash order; the pairing of equal
    ranks is one equi-join and serves every feature.
    """
    rows = _zeros(df, features).select(*ids, "label", *features)
    keyed = lambda s: rows.withColumn("_key", hash_key(s, *ids).cast("bigint")).withColumn("_slice", key_slice("_key"))
    ranked = lambda s: sliced_row_number(keyed(s), "_rank", [], ["_key", *ids], ["_slice"]).drop("_key", "_slice")
    partner = ranked(seed + 1).select("_rank", F.struct(*features).alias("_other"))
    paired = ranked(seed).join(partner, "_rank").drop("_rank")
    variants = [F.struct(F.lit("baseline").alias("feature"), *[F.col(c) for c in features])]
    for f in features:
        variants.append(F.struct(
            F.lit(f).alias("feature"), *[F.col(f"_other.{c}").alias(c) if c == f else F.col(c) for c in features]
        ))
    spread = paired.select(*ids, "label", F.explode(F.array(*variants)).alias("_v")).select(*ids, "label", "_v.*")
    losses = log_loss(score_binary(model, spread, features), by=["feature"])
    base = losses.filter("feature = 'baseline'").select("log_loss").scalar()
    return losses.filter("feature <> 'baseline'").select(
        "feature", "n", (F.col("log_loss") - base).alias("added_loss")
    ).orderBy(F.desc("added_loss"), "feature")


def window_summary(
    packets: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE, per_file: bool = False,
    label_domain: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Mean, deviation, maximum, first and last of each sequence feature per padded window.

    All are fixed-width aggregates in the window group-by, so no vector is built.
    """
    position = F.col("rn") - F.col("win") * stride
    extra: dict[str, Column] = {}
    for c in SEQUENCE_FEATURES:
        x = F.col(c).cast("double")
        mean = F.sum(x) / size
        extra[f"{c}_avg"] = mean
        extra[f"{c}_dev"] = F.sqrt(F.greatest(F.sum(x * x) / size - mean * mean, F.lit(0.0)))
        extra[f"{c}_max"] = F.greatest(F.max(x), F.when(F.count(F.lit(1)) < size, 0.0))
        extra[f"{c}_first"] = F.coalesce(F.max(F.when(position == 1, x)), F.lit(0.0))
        extra[f"{c}_last"] = F.coalesce(F.max(F.when(position == size, x)), F.lit(0.0))
    windows = session_windows(packets, size, stride, per_file, label_domain=label_domain, extra=extra)
    return windows, list(extra)


def vector_summary(windows: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """The columns of :func:`window_summary` from stored window vectors instead of packets."""
    width, out = len(SEQUENCE_FEATURES), {}

    def feature(place: int) -> Column:
        at = F.sequence(F.lit(place), F.lit((size - 1) * width + place), F.lit(width))
        return F.transform(at, lambda i: F.col("sequence_features")[i].cast("double"))

    for place, c in enumerate(SEQUENCE_FEATURES):
        steps = feature(place)
        sums = F.aggregate(steps, F.array(F.lit(0.0), F.lit(0.0)), lambda s, x: F.array(s[0] + x, s[1] + x * x))
        mean = sums[0] / size
        out |= {
            f"{c}_avg": mean, f"{c}_dev": F.sqrt(F.greatest(sums[1] / size - mean * mean, F.lit(0.0))), f"{c}_max": F.array_max(steps),
            f"{c}_first": F.col("sequence_features")[place].cast("double"),
            f"{c}_last": F.col("sequence_features")[(size - 1) * width + place].cast("double"),
        }
    return windows.withColumns(out)


def fit_sequence_model(
    windows: DataFrame, features: Sequence[str], weight: float = SEQUENCE_POSITIVE_WEIGHT, iterations: int = 50
) -> PipelineModel:
    """Weighted logistic regression on window summaries."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        LogisticRegression(labelCol="y", weightCol="w", maxIter=iterations, regParam=0.01, standardization=True),
    ]
    return Pipeline(stages=stages).fit(with_positive_weight(windows, weight))


def score_vectors(
    windows: DataFrame, make_predict: Callable[[], Callable], out: str = "t_score", batch: int = SCORING_BATCH
) -> DataFrame:
    """Score window vectors with an external network in Arrow batches.

    ``make_predict`` loads the network once per Python worker and returns a
    function from a (batch, steps * features) array to scores.
    """
    width = WINDOW_SIZE * len(SEQUENCE_FEATURES)
    score = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[width]]
    )
    return windows.withColumn(out, score("sequence_features"))


def continual_training(
    flows: DataFrame, features: Sequence[str], days: Sequence[str], ids: Sequence[str],
    retained_pct: float = 5.0, rounds: int = 20, key: Column | None = None,
) -> list[tuple[str, PipelineModel, int]]:
    """(day, model, rows fitted) per day, each fitted on that day plus a sample retained from the days before.

    ``days`` is the ordered list of capture days. What is retained is carried on as a table, so a day's
    fit reads that day, which a table by day prunes to its files, and the small sample, and
    never the days before. ``key`` decides by its value modulo 1000 which rows are retained.
    """
    drawn = F.pmod(key if key is not None else hash_key(42, *ids), F.lit(1000)) < retained_pct * 10
    models, retained = [], None
    for day in days:
        current = _zeros(flows.filter(F.col("capture_day") == day), features).select(*ids, "label", *[c for c in features if c not in ids])
        rows = materialize(current if retained is None else current.unionByName(retained), "continual")
        stages = [
            VectorAssembler(inputCols=list(features), outputCol="features"),
            LogisticRegression(labelCol="y", weightCol="w", maxIter=rounds, family="multinomial"),
        ]
        model = Pipeline(stages=stages).fit(with_positive_weight(rows, FLOW_POSITIVE_WEIGHT))
        models.append((day, model, rows.count()))
        retained = rows.filter(drawn)
    return models
