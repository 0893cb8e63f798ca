"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``; where it is unset and Spark runs
    in one process (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, and a lost executor costs what it was doing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
