"""New files as a stream: an extension that runs the same expressions as they arrive. Nothing here depends on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textveil.operators.providers import replaced


def texts(spark: SparkSession, root: str, schema: str = "doc_id long, text string", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(root)


def replace_stream(rows: DataFrame, provider: str, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Replaces texts of what has arrived and ends; started again it goes on from there, so nothing is done twice."""
    answer = replaced(F.col(text_col), provider)
    new = rows.withColumns({"new_text": answer["text"], "confidence": answer["confidence"]})
    return new.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
