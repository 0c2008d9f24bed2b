"""Tables written to the folder that driver and executors share, and read again.

A written table cuts the lineage and survives lost executors. The folder is
the session's ``spark.checkpoint.dir``; only a local session may go without,
a cluster's executors could not read what others wrote to their own disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
#: Rows and bytes of an Arrow batch at most: executor and worker each hold a batch whole, and texts are long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's size of an Arrow batch to ``ARROW``; a setting that is lower stays."""
    for name, most in ARROW.items():
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs; a session on a cluster must name one."""
    folder = spark.conf.get(CHECKPOINT, "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set(CHECKPOINT, folder)
    return folder.rstrip("/")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as far as ``columns`` have it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
