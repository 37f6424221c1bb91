"""Makes the package importable in the Python workers of any executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch: long texts would make one of 10,000 rows as large as a partition.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, and bound the session's Arrow batches.

    Workers unpickle kernels by reference, so the package has to be on their
    path even where the driver's working directory isn't shared.  A smaller
    bound that the session sets itself is kept.
    """
    now = spark.conf.get(BATCH_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ondelys-"), "ondelys-src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
