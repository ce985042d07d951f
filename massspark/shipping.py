"""Sending the package to the executors of a session that does not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application. The archive is made on the driver, which serves it to them."""
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        to = Path(tempfile.mkdtemp()) / "massspark"
        spark.sparkContext.addPyFile(shutil.make_archive(str(to), "zip", Path(__file__).resolve().parents[1], "massspark"))
