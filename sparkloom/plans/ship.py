"""Bringing this package to the executors, whose Python may not find it by itself."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's Python files, once."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="sparkloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)


def shipped(f):
    """f, whose first argument is a session, after the package has been shipped."""

    @functools.wraps(f)
    def run(spark, *rest):
        ship(spark)
        return f(spark, *rest)

    return run
