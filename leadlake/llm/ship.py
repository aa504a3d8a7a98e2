"""Run Arrow functions of this package on executors that may not have the package installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

import leadlake
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of texts are large, so fewer of them go into one Arrow batch than Spark's default.
BATCH, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_SENT: set[str] = set()


def ship_package(sc: SparkContext) -> None:
    """Hand the package to the session's executors once, as one does with ``spark-submit --py-files``."""
    if sc.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(leadlake.__file__))
    folder = tempfile.mkdtemp(prefix="leadlake-package-")  # of the driver alone: Spark serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"leadlake-{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for part in ("", "llm"):
            for name in sorted(os.listdir(os.path.join(root, part))):
                if name.endswith(".py"):
                    out.write(os.path.join(root, part, name), os.path.join("leadlake", part, name))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are reused and wait beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    ship_package(df.sparkSession.sparkContext)
    conf = df.sparkSession.conf
    if int(conf.get(BATCH)) > TEXTS_PER_BATCH:
        conf.set(BATCH, str(TEXTS_PER_BATCH))

    def work(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(work, schema)
