"""Session helpers: production settings and shipping of the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators assume: UTC days, adaptive plans with skew splitting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once, and the JVM outside its heap, whose
#: buffers grow by doubling and are there twice while a batch is sent.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def session(app: str = "tidemark", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments hold other ``spark.`` settings by full name."""
    spark = SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()
    spark.streams  # noqa: B018  state stores of batch queries need the stream manager
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent only a ``local`` master may go on, in a folder
    of this machine, as tests do.
    """
    key = "spark.checkpoint.dir"
    root = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(key, root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for what a query uses more than once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make a session ready for the operators.

    Arrow batches get at most ``BATCH_ROWS`` rows and, but for single larger
    rows, ``BATCH_BYTES``. The package is sent to the executors, once for each
    context, so that Python workers can import it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tidemark_shipped = True
