"""Materialised cuts in the folder all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where a session on one machine has none (as in tests) a folder of this machine is set; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(f"/tmp/checkpoints/{os.getpid()}")
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting that removes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, *, free: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a lineage cut that survives lost executors.

    ``free``: the shuffle files of the write go with its end, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
