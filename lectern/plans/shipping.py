"""Brings this package to the Python workers of a session, wherever they run and whatever their search path is."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a ZIP file that Spark hands to every worker."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(_PACKAGE.parent))), p.read_bytes())
    path = os.path.join(tempfile.gettempdir(), f"{_PACKAGE.name}-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip")
    if not os.path.exists(path):
        part = f"{path}.{os.getpid()}"
        Path(part).write_bytes(held.getvalue())
        os.replace(part, path)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
