"""Cutting lineage: results of iterations go to the checkpoint folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Only where a single process runs everything (local tests) is a temporary one set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="terrane-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder: it survives lost executors and later steps don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
