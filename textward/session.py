"""What every operator needs of a session: tables, the shared folder, the package on the executors."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Rows that go to a Python worker at once.
BATCH = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python workers import functions by name, so the package must be importable
    there even if the driver only has it on its own ``sys.path``.
    """
    # Records of whole texts: a batch of Spark's usual size takes hundreds of MB in a worker and beside the heap.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    folder = tempfile.mkdtemp(prefix="textward-")
    target = os.path.join(folder, f"textward-{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where nothing is set and the
    executors run on this machine, as in tests, a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='textward-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables of one job, written as Parquet into the shared folder.

    A written table cuts the lineage: losing an executor afterwards costs nothing
    that was computed before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; `name` is unique within the job."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files that no table refers to any more.

        Its cleaner acts when the driver collects garbage, which a small driver
        heap may not need for a long time.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
