"""Trained models on the feature matrix: boosted trees and a linear baseline, scoring, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_FEATURES, ENCODED_FEATURES, NUMERIC_FEATURES
from .clean import missing_columns
from .split import TRAIN, VALID

SEED = 42


def available(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical model inputs the frame has."""
    numeric = [c for c in NUMERIC_FEATURES if c not in missing_columns(df, NUMERIC_FEATURES)]
    return numeric, [c for c in CATEGORICAL_FEATURES if c in df.columns]


def fit_encoder(train: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> StringIndexerModel:
    """Category codes, fitted once on training data and reused everywhere; unseen values get their own code."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_encoded" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(train)


def encode(df: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    return encoder.transform(df)


def vector_columns(df: DataFrame) -> DataFrame:
    """Add ``features``: the model vector as float array in its fixed order; null counts as 0."""
    names = [*NUMERIC_FEATURES, *ENCODED_FEATURES]
    return df.withColumn("features", F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names]))


_INPUT = "_in_"


def _assembled(df: DataFrame) -> list:
    """Stages up to the model vector. A missing number counts as 0, as in the stored vectors."""
    numeric, categorical = available(df)
    filled = ", ".join(f"coalesce(double({c}), 0D) AS {_INPUT}{c}" for c in numeric)
    stages: list = [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")]
    if categorical:
        stages.append(
            StringIndexer(inputCols=categorical, outputCols=[f"{_INPUT}{c}" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
        )
    inputs = [f"{_INPUT}{c}" for c in [*numeric, *categorical]]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_vector")]


def fit_gbt(train: DataFrame, valid: DataFrame, target: str = "sales", rounds: int = 1000, tol: float = 0.01, depth: int = 6, step: float = 0.05) -> PipelineModel:
    """Boosted trees, stopped early on the validation rows. Spark stops on a tolerance, not on patience."""
    rows = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    gbt = GBTRegressor(
        featuresCol="_vector", labelCol=target, predictionCol="prediction", validationIndicatorCol="_valid",
        maxIter=rounds, maxDepth=depth, stepSize=step, validationTol=tol, seed=SEED, maxBins=64, cacheNodeIds=True,
    )
    return Pipeline(stages=[*_assembled(train), gbt]).fit(rows)


def fit_linear(train: DataFrame, target: str = "sales", regularisation: float = 0.0) -> PipelineModel:
    linear = LinearRegression(featuresCol="_vector", labelCol=target, predictionCol="prediction", regParam=regularisation)
    return Pipeline(stages=[*_assembled(train), linear]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; helper columns of the model are dropped."""
    scored = model.transform(df)
    return scored.drop("_vector", *[c for c in scored.columns if c.startswith(_INPUT)])


def trained_forecaster(fit, folds: DataFrame, target: str = "sales"):
    """A model that is trained per fold, as a cross-validation model. ``fit(train, valid)`` → PipelineModel.

    ``folds`` is the table of the fold borders, one row each (:func:`~saleswright.operators.split.folds`): their numbers come from
    there, not from another pass over the rows. Each fold is one distributed fit.
    """

    def predict(rows: DataFrame) -> DataFrame:
        parts = None
        for fold in sorted(r[0] for r in folds.select("fold").collect()):
            mine = rows.where(F.col("fold") == fold)
            train, valid = mine.where(F.col("role") == TRAIN), mine.where(F.col("role") == VALID)
            part = score(fit(train, valid), valid).select(
                "fold", "unique_id", F.col("date").alias("ds"), F.col(target).alias("y"), F.col("prediction").alias("y_hat")
            )
            parts = part if parts is None else parts.unionByName(part)
        return parts

    return predict


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tree_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importance per input of the fitted trees: one row per model input."""
    assembler, trees = model.stages[-2], model.stages[-1]
    values = trees.featureImportances.toArray()
    rows = [(name.removeprefix(_INPUT), float(values[i])) for i, name in enumerate(assembler.getInputCols())]
    return spark.createDataFrame(rows, "feature string, importance double")
