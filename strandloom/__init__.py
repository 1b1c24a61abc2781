"""Sequence analytics on Spark: search, count and relate symbol sequences held in tables."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
