"""Session helpers shared by the operators: table access, code shipping, durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 2000, *by: str) -> DataFrame:
    """``df`` dealt out (by the columns ``by``, if any) so that a task has some ``rows`` rows, for work that costs far more than the bytes by which Spark splits a table.

    Counting a Parquet table reads its footers only. The number is given outright, so adaptive execution does not join small partitions again.
    """
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(most, -(-df.count() // rows)), *by)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Workers need to import the package wherever they run; the zip travels by Spark's
    own file server, so no shared folder is assumed.
    """
    context = spark.sparkContext
    if getattr(context, "_foliant_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="foliant-code-"), "foliant_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("foliant", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._foliant_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Only where neither is set and everything runs on one machine (tests), a local folder is used and set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliant-checkpoints-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` to a table in the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation with other row orders.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliant/{label}-{uuid.uuid4().hex}"
    # The JVM never compiles a method of over 8000 bytes: Spark is told to cut code into smaller ones rather than run it so.
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, min(int(before), 8000))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(limit, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._settled = path
    return written


def forget(written: DataFrame) -> None:
    """Delete a table of :func:`settle` that nothing will read again."""
    context = written.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(written._settled)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
