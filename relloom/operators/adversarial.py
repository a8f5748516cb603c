"""Adversarial validation: how much does each train row look like a test row?"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.split import origin_table, stratified_split


def pair_text(df: DataFrame) -> DataFrame:
    """Entities and sentence in one text, as the classifier reads them."""
    return df.withColumn(
        "pair_text", F.concat_ws(" [SEP] ", "object_entity", "subject_entity", "sentence")
    )


def fit_origin(
    train: DataFrame, test: DataFrame, features: int = 1 << 14, iterations: int = 20, seed: int = 42
) -> PipelineModel:
    """Words to hashed counts to a logistic model of train (0) or test (1), fitted on 80 % of the rows."""
    columns = ["id", "sentence", "subject_entity", "object_entity"]
    # The origin enters the hash, since ids of both sides may meet.
    origin = origin_table(train.select(columns), test.select(columns)).withColumn(
        "id", F.concat_ws("-", "comes_from", "id")
    )
    parts = stratified_split(pair_text(origin), strata="comes_from", test_size=0.2, seed=seed)
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="pair_text", outputCol="words", pattern=r"\s+"),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features),
            LogisticRegression(
                featuresCol="features", labelCol="comes_from", maxIter=iterations, regParam=0.01
            ),
        ]
    ).fit(parts.where("split = 'train'").select("pair_text", "comes_from"))


def origin_weights(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(place, weight) of the fitted model, -1 the intercept; places without weight are left out."""
    fitted = model.stages[-1]
    rows = [(-1, float(fitted.intercept))] + [(k, float(w)) for k, w in enumerate(fitted.coefficients.toArray()) if w]
    return spark.createDataFrame(rows, "place int, weight double")


def adversarial_scores(
    train: DataFrame, test: DataFrame, features: int = 1 << 14, iterations: int = 20, seed: int = 42
) -> DataFrame:
    """Fit train-vs-test, add P(test) as ``prob_1`` to all train rows."""
    scored = fit_origin(train, test, features, iterations, seed).transform(pair_text(train))
    return scored.select(*train.columns, vector_to_array("probability")[1].alias("prob_1"))
