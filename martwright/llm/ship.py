"""Hand this package to the executors of a session, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_NAME = "martwright_tasks.zip"


def ship(spark: SparkSession) -> None:
    """Once a session: Spark serves the zip to its executors and puts it on the workers' path."""
    sc = spark.sparkContext
    if _NAME in sc._python_includes:
        return
    made = Path(tempfile.mkdtemp(prefix="martwright-")) / _NAME
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(made))
