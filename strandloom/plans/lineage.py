"""Cutting the lineage of iterative plans, and letting go of tables that no later plan reads."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine, as in tests, gets one of its own where none is set."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read back: a lost executor then costs no recomputation. The table goes with the application, or by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


#: Rows of a few numbers that a task sorts or holds, on average.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to as many parts as the counted rows need at ``TASK_ROWS`` each: whatever groups or orders by the keys then exchanges no more, and a task's rows don't grow with the table."""
    own = -(-df.count() // TASK_ROWS)
    return df.repartition(max(own, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def release(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote. For tables that nothing still to be run reads."""
    for table in tables:
        if path := table.__dict__.pop("_cut_path", None):
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)
