"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the folder in spark.checkpoint.dir and read again; only where that is unset and all runs on
    this machine, as in tests, to a folder of our own."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found := tempfile.mkdtemp(prefix="textveil-"))
    df.write.parquet(path := f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)
