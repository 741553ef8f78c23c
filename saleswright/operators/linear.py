"""Linear models: fitting by aggregates, scoring and contributions row by row.

A fitted model is a handful of numbers (one slope and one mean per feature). Fitting is an action, as it
is in Spark ML; scoring puts the numbers into the plan as literals, so it needs no join and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """prediction = base + Σ beta·(x − mean), features in order."""

    features: tuple[str, ...]
    base: float
    betas: tuple[float, ...]
    means: tuple[float, ...]

    def term(self, i: int, x: Column) -> Column:
        return F.lit(self.betas[i]) * (x.cast("double") - F.lit(self.means[i]))

    def predict(self, values: Sequence[Column] | None = None) -> Column:
        xs = values if values is not None else [F.col(f) for f in self.features]
        return reduce(lambda a, b: a + b, [self.term(i, x) for i, x in enumerate(xs)], F.lit(self.base))


def _means(features: Sequence[str]) -> list[Column]:
    return [F.avg(F.col(f).cast("double")) for f in features]


def marginal_linear(train: DataFrame, features: Sequence[str], target: str = "sales") -> LinearModel:
    """Average of the single-feature least-squares lines: slopes and means in one aggregation.

    A feature that does not vary has slope 0.
    """
    y, n = F.col(target).cast("double"), float(len(features))
    slopes = [F.coalesce(F.regr_slope(y, F.col(f).cast("double")), F.lit(0.0)) / n for f in features]
    row = train.agg(F.avg(y), F.array(*slopes), F.array(*_means(features))).first()
    return LinearModel(tuple(features), row[0], tuple(row[1]), tuple(row[2]))


def from_regression(model: LinearRegressionModel, train: DataFrame, features: Sequence[str]) -> LinearModel:
    """A fitted Spark ML model; base is its prediction at the means of the training rows."""
    betas = tuple(float(b) for b in model.coefficients)
    means = tuple(train.agg(F.array(*_means(features))).first()[0])
    base = float(model.intercept) + sum(b * m for b, m in zip(betas, means))
    return LinearModel(tuple(features), base, betas, means)


def score_linear(df: DataFrame, model: LinearModel, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, model.predict())


def linear_contributions(df: DataFrame, model: LinearModel) -> DataFrame:
    """Add base_value, prediction and ``contributions``: array of position, feature, value, contribution.

    base_value + Σ contribution = prediction, per row.
    """
    parts = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
            model.term(i, F.col(f)).alias("contribution"),
        )
        for i, f in enumerate(model.features)
    ]
    return df.withColumns({"base_value": F.lit(model.base), "prediction": model.predict(), "contributions": F.array(*parts)})
