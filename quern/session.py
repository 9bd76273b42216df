"""Spark session with the settings that this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quern", master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``settings`` override ours (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application.

    Functions that run there are pickled by reference, so their module has to be
    importable; a folder on the driver's path alone is not.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quern-")) / "quern_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
