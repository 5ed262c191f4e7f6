"""Multi-class flow classifier: from labelled flows to a scored test side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.features import engineer_features, feature_names
from flowlens.operators.boosting import BoostedTrees, Settings, fit_boosted
from flowlens.operators.scaling import apply_flow_scaler, fit_flow_scaler
from flowlens.operators.split import attack_priority, permutation_split
from flowlens.session import materialize


#: Fewer and larger steps than the fixed ones, and trees of at most 64 leaves: a pass per level of a round.
QUICK = Settings(rounds=40, patience=3, depth=5, step=0.4)


@dataclass
class FlowClassifier:
    model: BoostedTrees
    scaler: DataFrame

    @property
    def labels(self) -> list[str]:
        return self.model.labels

    @property
    def features(self) -> list[str]:
        return self.model.features

    def score(self, flows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns, the scaled features, ``pred_label``, ``probs`` and ``x_score``."""
        rows = engineer_features(flows, list(keep))
        return self.model.score(apply_flow_scaler(rows, self.scaler, self.features, clamp=True))

    def save(self, path: str) -> None:
        """Model and scaler as two tables below ``path``, for :meth:`load` in another program."""
        self.model.to_rows(self.scaler.sparkSession).write.mode("overwrite").parquet(f"{path}/model")
        self.scaler.write.mode("overwrite").parquet(f"{path}/scaler")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FlowClassifier":
        return FlowClassifier(BoostedTrees.from_rows(spark.read.parquet(f"{path}/model")), spark.read.parquet(f"{path}/scaler"))


def train_flow_classifier(
    train: DataFrame, ids: Sequence[str], max_total: int = 12_000_000, settings: Settings = Settings(), file_key: Column | None = None,
) -> FlowClassifier:
    """Attack-priority load, 43 features, train-side scaling, class weights, boosted trees on 90 %.

    Rounds end when the weighted log-loss of the other 10 % has not fallen for ``settings.patience`` rounds.
    """
    names = feature_names()
    # read by the scaler fit, the weights, the bins and the boosting: stored before scaling
    parts = materialize(permutation_split(attack_priority(train, max_total, file_key), ids), "training-rows")
    features = materialize(engineer_features(parts, [*ids, "label", "split"]), "training-features")
    scaler_rows = fit_flow_scaler(features.filter("split = 'train'"), names).collect()
    scaler = train.sparkSession.createDataFrame(scaler_rows, "feature string, mean double, std double")
    scaled = apply_flow_scaler(features, scaler, names, clamp=True).withColumn("held_out", F.col("split") == "eval")
    return FlowClassifier(fit_boosted(scaled, names, "held_out", ids, settings), scaler)
