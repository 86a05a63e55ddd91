"""Making the package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per application; a no-op for later calls.

    Generated methods beyond 8 000 bytes are never compiled by the JVM, so stages that would have one are generated by expression instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="folia-package-"), "folia_package.zip")  # executors fetch it later
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark
