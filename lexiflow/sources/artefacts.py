"""Fitted artefacts: classifier models and dictionaries, addressed by explicit path.

Models use the Spark ML writer (never pickle) or, with coefficients in blocks, parquet
tables; dictionaries and memories are
parquet tables.  Loading a missing artefact either raises or, for optional
cascade stages, returns ``None`` so the stage is planned out.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from lexiflow.operators.classify import BlockModel
from lexiflow.session import path_exists


def save_model(model: PipelineModel | BlockModel, path: str) -> str:
    if isinstance(model, BlockModel):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str, optional: bool = False) -> PipelineModel | BlockModel | None:
    if not path_exists(spark, path):
        if optional:
            return None
        raise FileNotFoundError(f"model not found: {path}; train it first")
    if path_exists(spark, f"{path}/block-model"):
        return BlockModel.load(spark, path)
    return PipelineModel.load(path)


def save_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def load_table(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    if not path_exists(spark, path):
        if optional:
            return None
        raise FileNotFoundError(f"table not found: {path}")
    return spark.read.parquet(path)
