"""Makes the library importable in Python workers, and sets what its queries count on in a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()

#: Shuffle files go when the action that made them ends, and a Python worker gets few bytes at a time.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def ensure(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once (like ``--py-files``), and make the session's settings."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)
