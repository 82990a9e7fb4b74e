"""Session settings and what Python workers need to import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with --py-files; then the folder's absence does no harm.
    """
    home = str(Path(__file__).resolve().parent.parent)
    now = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if home not in now.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, now) if x)
