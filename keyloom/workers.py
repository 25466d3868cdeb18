"""Python workers that find this package, whatever folder they start in."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def findable(spark: SparkSession) -> None:
    """Let workers started from now on import this package."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def ready(df: DataFrame) -> DataFrame:
    findable(df.sparkSession)
    return df
