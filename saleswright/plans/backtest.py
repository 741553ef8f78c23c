"""The flagship question: how good is the seasonal-naive forecast per family on the held-out days?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clip_negative
from ..operators.enrich import enrich
from ..operators.evaluate import metrics
from ..operators.facts import latest
from ..operators.forecast import naive_forecaster
from ..operators.split import TRAIN, VALID
from .features import build_feature_matrix


def holdout_rows(features: DataFrame, days: int) -> DataFrame:
    """Train and valid rows of one time split as a single fold: fold, role, unique_id, ds, y, family."""
    border = F.date_sub(latest(features.select("date")), days)
    role = F.when(F.col("date") < border, TRAIN).otherwise(VALID)
    return features.select(
        "unique_id", F.col("date").alias("ds"), F.col("sales").alias("y"), F.lit(1).alias("fold"), role.alias("role"))


def naive_holdout(fact: DataFrame, external: dict[str, DataFrame], horizon: int, days: int) -> DataFrame:
    """Enrich, build features, split by time, forecast, and score per family."""
    features = build_feature_matrix(enrich(clip_negative(fact), external), horizon)
    scored = naive_forecaster()(holdout_rows(features, days))
    families = scored.withColumn("family", F.element_at(F.split("unique_id", "_", 2), 2))
    return metrics(families, ["family"])
