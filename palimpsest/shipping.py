"""Hands the package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(_PACKAGE.parent))
    file = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    file.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that first sees to it that executors have the package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run
