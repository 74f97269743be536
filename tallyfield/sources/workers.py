"""Python workers that can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Workers that start from now on have the package's folder in their PYTHONPATH, as the driver has it.

    A cluster needs the package installed or sent along; this serves sessions that see the same folder.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, have)))
