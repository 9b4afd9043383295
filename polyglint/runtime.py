"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Pin the time zone and let Python workers import this package by the driver's own path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, known)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may use any scheme that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
