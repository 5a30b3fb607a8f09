"""Session defaults used by the bench, the tests and stand-alone jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; every setting can be overridden.

    ``spark.sql.shuffle.partitions`` is left to the cluster (AQE coalesces small partitions).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # HotSpot does not compile methods above 8000 bytes of code; past that, Spark's split
        # functions are faster than one fused method (wide conversions reach it).
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions of the package that run in workers are found by module name there. Workers see the package by
    themselves only where it is installed or on their PYTHONPATH; a notebook or a script that extends ``sys.path``
    changes the driver alone.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quayside-package-")) / "quayside.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
