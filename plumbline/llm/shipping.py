"""Makes this package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import plumbline

_NAME = "plumbline-package.zip"


def ship(spark: SparkSession) -> None:
    """Hand the package to every executor, once per Spark context, as ``--py-files`` does."""
    context = spark.sparkContext
    if any(os.path.basename(f) == _NAME for f in context.listFiles):
        return
    home = os.path.dirname(os.path.abspath(plumbline.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), _NAME)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
