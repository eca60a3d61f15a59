"""Results that are read several times, stored once in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir`` if the cluster names one.

    Only where neither the setting nor the context has a folder, and all runs on one machine, a
    temporary one is made; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lineloom-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and written by columns, so that each reader takes only the columns it needs."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
