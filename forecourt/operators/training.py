"""Training of the price model. The hyper-parameters are our own choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.operators.encoder import encode, fit_codes, read_codes
from forecourt.schema import REQUEST_NUMBERS, TEXT_COLUMNS
from forecourt.session import scratch_path, shared_dir

CODES = [f"{c}_code" for c in TEXT_COLUMNS]
NUMBERS = [f"{c}_num" for c in REQUEST_NUMBERS]


@dataclass(frozen=True)
class ModelParams:
    kind: str = "boosting"  # or "forest", "tree"
    trees: int = 100
    depth: int = 3
    step: float = 0.1
    max_bins: int = 128
    seed: int = 42


@dataclass(frozen=True)
class PriceModel:
    """The code table, and the fitted stages that take codes and numbers to a prediction."""

    codes: DataFrame
    stages: PipelineModel

    def transform(self, numbered: DataFrame) -> DataFrame:
        """Add codes, features and prediction to rows with `<field>_num` columns.

        A value without a code makes its features and prediction missing, not the job fail.
        """
        return self.stages.transform(encode(numbered, self.codes, TEXT_COLUMNS))


def scaler() -> list:
    return [
        VectorAssembler(inputCols=NUMBERS, outputCol="numbers", handleInvalid="keep"),
        StandardScaler(inputCol="numbers", outputCol="scaled_numbers", withMean=True, withStd=True),
    ]


def _regressor(params: ModelParams, label: str):
    common = dict(
        featuresCol="features", labelCol=label, predictionCol="prediction",
        maxDepth=params.depth, maxBins=params.max_bins, seed=params.seed,
    )
    if params.kind == "boosting":
        return GBTRegressor(maxIter=params.trees, stepSize=params.step, checkpointInterval=10, **common)
    if params.kind == "forest":
        return RandomForestRegressor(numTrees=params.trees, **common)
    if params.kind == "tree":
        return DecisionTreeRegressor(**common)
    raise ValueError(f"unknown model kind: {params.kind}")


def price_stages(params: ModelParams, label: str = "price") -> Pipeline:
    # Codes are plain numbers to the trees: nothing marks them as categories.
    return Pipeline(stages=[
        *scaler(),
        VectorAssembler(inputCols=[*CODES, "numbers"], outputCol="raw_features", handleInvalid="keep"),
        VectorAssembler(inputCols=[*CODES, "scaled_numbers"], outputCol="features", handleInvalid="keep"),
        _regressor(params, label),
    ])


def train(clean: DataFrame, params: ModelParams = ModelParams(), label: str = "price") -> PriceModel:
    """Fit encoder, scaler and regressor on a clean table.

    The encoded rows are written, so that the passes of the trees do not join again.
    """
    spark = clean.sparkSession
    shared_dir(spark)  # boosting cuts its lineage there
    numbered = clean.select(
        *TEXT_COLUMNS, *[F.col(c).cast("double").alias(f"{c}_num") for c in REQUEST_NUMBERS],
        F.col(label).cast("double").alias(label),
    )
    codes = fit_codes(numbered, TEXT_COLUMNS)
    path = scratch_path(spark, "encoded")
    encode(numbered, codes, TEXT_COLUMNS).drop(*TEXT_COLUMNS).write.parquet(path)
    return PriceModel(codes, price_stages(params, label).fit(spark.read.parquet(path)))


def split(df: DataFrame, columns: list[str], share: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the row, the same for any partitioning."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(100))
    return df.filter(bucket < share), df.filter(bucket >= share)


def evaluate(model: PriceModel, clean: DataFrame, label: str = "price") -> dict[str, float]:
    numbered = clean.withColumns({f"{c}_num": F.col(c).cast("double") for c in REQUEST_NUMBERS})
    predicted = model.transform(numbered).select(label, "prediction").persist()
    try:
        return {
            metric: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric).evaluate(predicted)
            for metric in ("rmse", "mae", "r2")
        }
    finally:
        predicted.unpersist()


def save(model: PriceModel, path: str) -> None:
    """The stages and the code table side by side; the table is written by Spark's tasks."""
    model.stages.write().overwrite().save(f"{path}/stages")
    model.codes.write.mode("overwrite").partitionBy("field").parquet(f"{path}/codes")


def load(spark: SparkSession, path: str) -> PriceModel:
    return PriceModel(read_codes(spark, f"{path}/codes"), PipelineModel.load(f"{path}/stages"))
