"""Sharding (operator 9): longest-processing-time scheduling of groups that must stay together.

Rows with equal texts form a group. Groups, sorted by size, go to the least-loaded shard through a heap. The heap runs on
the driver over a bounded number of items: each group that holds more than 1/LARGE of all bytes is an item of its own
(there are fewer than LARGE of them); the small groups are dealt by a hash to BUNDLES bundles, and each bundle is an item.
Shards then differ by less than one bundle or the smallest large group. A group never reaches the driver as rows."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import written

LARGE = 1 << 14
BUNDLES = 1 << 15
#: Rows that are numbered together, about.
GROUP = 20_000


def schedule(items: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Shard of each item (size, key): largest first, each to the shard with the least so far; ties to the lower shard."""
    loads = [(0, k) for k in range(n_shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heapq.heappop(loads)
        placed[key] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    size is the text's UTF-8 bytes plus 1. Null and empty texts are equal, of size 1. Repeated rows are rows of one
    group; a null id is kept. Other columns are not looked at. An empty table gives an empty table. Slots number the rows
    of a shard from 0 without gaps, by a hash, so that a shard, or a group, of any size is numbered by many tasks."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()

    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"))
    bundle = F.pmod("text_key", F.lit(BUNDLES)).cast("int")
    groups = groups.select("size", bundle.alias("bundle"), F.when(F.col("size") * LARGE > total.size, F.col("text_key")).alias("large"))
    items = groups.groupBy("bundle", "large").agg(F.sum("size").alias("size"))  # at most LARGE + BUNDLES rows
    placed = schedule([(r.size, (r.bundle, r.large)) for r in items.collect()], n_shards)
    shards = spark.createDataFrame([(b, large, s) for (b, large), s in placed.items()], "bundle int, large long, shard int")

    bundles = F.broadcast(shards.where("large is null").select("bundle", F.col("shard").alias("of_bundle")))
    larges = F.broadcast(shards.where("large is not null").select(F.col("large").alias("text_key"), F.col("shard").alias("of_large")))
    found = rows.withColumn("bundle", bundle).join(larges, "text_key", "left").join(bundles, "bundle", "left").withColumn("shard", F.coalesce("of_large", "of_bundle"))

    found = found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(total.n // (n_shards * group) + 1)).cast("int"))
    sizes = found.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("text_key", "doc_id", "row")) - 1
    numbered = found.withColumn("at", slot).join(sizes.select("shard", "part", before.alias("before")), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """The real output: the rows of docs in one folder per shard. For tables whose ids are unique."""
    docs.join(assigned.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col).write.partitionBy("shard").parquet(path)
