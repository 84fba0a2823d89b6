"""A learned predictor of scores from text: hashed words and a linear model for each head, trained here."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, text: str, heads: dict[str, tuple[str, Column]], weight: str | None = None, bits: int = 12, ridge: float = 0.1) -> dict[str, PipelineModel]:
    """heads: name: (target, mask). Rows whose text or target is missing, or whose weight is 0, teach nothing. What the driver holds
    is a model's 2 ** bits numbers."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+")
    hashed = HashingTF(inputCol="_words", outputCol="_features", numFeatures=1 << bits, binary=True)
    models = {}
    for head, (target, mask) in heads.items():
        rows = df.filter(mask & F.col(target).isNotNull() & (F.coalesce(F.col(text), F.lit("")) != ""))
        rows = rows.select(F.col(text).alias("_text"), F.col(target).cast("double").alias("_label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_weight")).filter("_weight > 0")
        model = LinearRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_out", regParam=ridge, solver="l-bfgs", maxIter=20)
        models[head] = PipelineModel([words, hashed, model.fit(hashed.transform(words.transform(rows)))])
    return models


def predict(df: DataFrame, text: str, models: dict[str, PipelineModel]) -> DataFrame:
    """``df`` with a column for each head, within 0 and 1; 0.5 for empty text."""
    out, empty = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), F.col("_text") == ""
    for head, model in models.items():
        made = model.transform(out)
        out = made.withColumn(head, F.when(empty, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_out"))))).drop("_words", "_features", "_out")
    return out.drop("_text")


def weights(model: PipelineModel, spark) -> list[float]:
    return spark.createDataFrame([(model.stages[-1].coefficients,)], ["w"]).select(vector_to_array("w").alias("w")).first()["w"]
