"""Making this package importable by Python workers that do not share the driver's folders."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors through Spark, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="panelwright-")) / "panelwright.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
