"""Sessions with the settings that the library's plans expect."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def session(name: str = "bindery", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` replace dots in names by double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that would not find it by their own path."""
    context = spark.sparkContext
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or ROOT in map(os.path.abspath, filter(None, found)):
        return
    folder = tempfile.mkdtemp(prefix="bindery-")  # the driver serves the file from here
    context.addPyFile(shutil.make_archive(f"{folder}/bindery", "zip", ROOT, "bindery"))
    _shipped.add(context.applicationId)
