"""What Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed, if the folder is there for them too."""
    here, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = paths.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        paths["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])
