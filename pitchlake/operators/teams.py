"""Teams from crop embeddings: reduction to three dimensions, then two clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(crops: DataFrame, column: str) -> DataFrame:
    return crops.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))


def fit_teams(crops: DataFrame, column: str = "embedding", k: int = 2, dimensions: int = 3, seed: int = 7) -> PipelineModel:
    """Principal components stand in for a manifold method, which Spark lacks."""
    stages = [PCA(k=dimensions, inputCol="_v", outputCol="_r"), KMeans(k=k, seed=seed, featuresCol="_r", predictionCol="team_id")]
    return Pipeline(stages=stages).fit(_vectors(crops, column))


def classify(model: PipelineModel, crops: DataFrame, column: str = "embedding") -> DataFrame:
    return model.transform(_vectors(crops, column)).drop("_v", "_r")


def lock_teams(classified: DataFrame, keys: tuple[str, ...] = ("video_id", "tracker_id"), order: str = "frame_idx") -> DataFrame:
    """(keys, team_id): the team of each track's first crop, once for the whole video."""
    return classified.groupBy(*keys).agg(F.min_by("team_id", order).alias("team_id"))
