"""Retraining as a job: fit, store as the next version, and only then let readers see it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.operators import learn
from tallywright.session import staged
from tallywright.sources import sinks


def retrain(spark: SparkSession, store: str, base: DataFrame, labelled: DataFrame, features: list[str] | None = None, trees: int = 160) -> int:
    """Fit the score model to base and reviewed rows and add it to the store; gives its version. Rows are a stage: fitting reads them often."""
    names = features or learn.FEATURES
    rows = staged(learn.training_rows(base, labelled), "training-rows")
    n = {r.weight: r["count"] for r in rows.groupBy("weight").count().collect()}  # two weights
    model = learn.fit_score_model(rows, names, trees)
    return sinks.add_model_version(model, store, spark, n.get(1.0, 0), n.get(learn.K.LABEL_WEIGHT, 0), names)
