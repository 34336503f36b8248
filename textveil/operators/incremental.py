"""Runs that skip what has not changed, by a manifest of checksums and format versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["root", "provider", "stage"]


def compared(inputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """inputs (root, provider, stage, checksum, version) with state: new, changed or unchanged against the manifest."""
    old = manifest.select(*KEY, F.col("checksum").alias("__checksum"), F.col("version").alias("__version"))
    same = F.col("checksum").eqNullSafe(F.col("__checksum")) & F.col("version").eqNullSafe(F.col("__version"))
    state = F.when(F.col("__version").isNull() & F.col("__checksum").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return inputs.join(old, KEY, "left").withColumn("state", state).drop("__checksum", "__version")


def to_run(inputs: DataFrame, manifest: DataFrame) -> DataFrame:
    return compared(inputs, manifest).where("state <> 'unchanged'").drop("state")


def updated(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest after a run: what was done replaces what stood there under the same key."""
    return manifest.join(done, KEY, "left_anti").unionByName(done.select(manifest.columns))
