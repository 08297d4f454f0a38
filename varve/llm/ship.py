"""Making this package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


#: Bytes of an Arrow batch that goes to a Python worker, where the session names no limit of its own.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's source to all workers, once per Spark context, as spark-submit's --py-files would.

    Also bounds the batches that workers get by bytes: Spark's default bounds their rows alone, whatever the texts weigh.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_varve_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="varve-code-")) / "varve.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._varve_shipped = True
