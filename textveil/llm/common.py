"""What the operators share: tables, and the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids (with a little more) that are broadcast at most: some 40 MB. Joins with more rows are shuffled.
MOST_BROADCAST = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset and everything runs on this
    machine, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="textveil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: what made them is not run twice, and a lost
    executor takes none of them with it."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := shared_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table of few columns for a join: marked for broadcast if it has at most `most` rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, id_col: str, text_col: str, key: str) -> tuple[DataFrame, bool]:
    """docs with a column `key` that tells different rows apart and ascends with their ids, those without an id last;
    and whether rows had to be numbered for that.

    Where ids are whole and unique, the key is the id. Else rows that differ in id or text are numbered (rows that agree
    in both get one number), and the numbers are written once, so that they are the same whenever they are read."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").limit(1).count():
        return docs.withColumn(key, F.col(id_col).cast("long")), False
    names = [free_name(docs, f"__{x}_of_row") for x in ("id", "text", "none")]
    of = [F.col(id_col).cast("long"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), F.col(text_col).isNull()]
    keyed = docs.withColumns(dict(zip(names, of)))
    order = [F.col(names[0]).asc_nulls_last(), *names[1:]]
    kinds = keyed.select(*names).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(kinds.withColumn(key, F.monotonically_increasing_id()), "numbered-rows")
    same = keyed[names[0]].eqNullSafe(numbered[names[0]]) & (keyed[names[1]] == numbered[names[1]]) & (keyed[names[2]] == numbered[names[2]])
    return keyed.join(numbered, same).select(*(keyed[c] for c in docs.columns), key), True


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f for mapInArrow, in a worker process that gives the memory it has freed back when a partition is done: workers
    are kept, and what they hold would add up with what the next stage needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
