"""Reading the given tables and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks share work that its bytes do not show, as many small files: adaptive execution goes by bytes and would leave it to a few."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir.

    Where the session names none, a local one is made, for tests in one process only; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage.

    A lost executor then costs a re-read, not a re-run, and what follows sees fixed rows.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: judged by its packed file, a table many times as large would go to all tasks through the driver."""
    return rows.hint("merge")


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and that nothing reads any more.

    Needs a session with a JVM of its own; elsewhere the files stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    if not hasattr(spark, "_jsparkSession"):
        return
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
