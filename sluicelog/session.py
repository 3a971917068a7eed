"""Session defaults."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the operators rely on; the rest is the cluster's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "sluicelog", **conf: str) -> SparkSession:
    """The running session, or a new one with ``DEFAULTS`` and ``conf``."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if getattr(context, "_sluicelog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sluicelog-")) / "sluicelog.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sluicelog_shipped = True
