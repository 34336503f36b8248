"""Token ids as binary files (operator 2): bit-plane shuffled blocks with a chunk index.

The ids of all documents, each followed by an end id, form one stream in ascending doc_id order. The stream is cut into
blocks of a fixed number of ids. A block of n ids is transposed into planes: plane k holds bit k of every id (or byte k,
with planes="byte"); the high planes are nearly constant and so compress well. Each plane is one zstandard frame.

A folder holds Parquet files as the container, since Spark commits them as a whole on any store: one row per block, with
its place (part, block, first id), the planes, and the chunk index: ordinal, id, start and length of each document that
has ids in the block. Parts are ranges of doc_id in ascending order; the stream of a part begins where the part before
ends. A block can be read alone, so readers scan in parallel and need no other block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.llm.crc import joined_crc32
from textveil.llm.tokens import encoder

#: Ids in a block.
BLOCK = 1 << 16
LEVEL = 1
_DOCS = pa.list_(pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", _DOCS)])
BLOCKS_SQL = "part int, block long, first long, n_ids int, kind string, planes array<binary>, docs array<struct<ordinal:long,doc_id:long,start:long,length:long>>"


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, lowest first, each a zstandard frame; as many as the largest id needs."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    bits_used = max(1, int(ids.max(initial=0)).bit_length())
    width = 2 if bits_used <= 16 else 4
    octets = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    if kind == "byte":
        return [pack(octets[k].tobytes()) for k in range((bits_used + 7) // 8)]
    return [pack(np.packbits(octets[k // 8] & np.uint8(1 << k % 8), bitorder="little").tobytes()) for k in range(bits_used)]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "bit") -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    octets = np.zeros((4, n_ids), np.uint8)
    for k, plane in enumerate(planes):
        values = np.frombuffer(unpack(plane), np.uint8)
        if kind == "byte":
            octets[k] = values
        else:
            octets[k // 8] |= np.unpackbits(values, count=n_ids, bitorder="little") << np.uint8(k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


class _Part:
    """Cuts the stream of a part into blocks; holds the ids of one block and of one document at most."""

    def __init__(self, part: int, kind: str, block: int):
        self.part, self.kind, self.block = part, kind, block
        self.first = self.end = self.number = self.ordinal = 0
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        doc = {"ordinal": self.ordinal, "doc_id": doc_id, "start": self.end, "length": len(ids)}
        self.ordinal += 1
        while len(ids):
            take = ids[: self.first + self.block - self.end]
            self.docs.append(doc)
            self.ids.append(take)
            self.end += len(take)
            ids = ids[len(take) :]
            if self.end == self.first + self.block:
                yield self.flush()

    def flush(self) -> dict:
        ids = np.concatenate(self.ids)
        row = {"part": self.part, "block": self.number, "first": self.first, "n_ids": len(ids), "kind": self.kind, "planes": to_planes(ids, self.kind), "docs": self.docs}
        self.first, self.number, self.ids, self.docs = self.end, self.number + 1, [], []
        return row


def write_token_files(docs: DataFrame, path: str, vocabulary: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = BLOCK, planes: str = "bit") -> None:
    """Writes the token ids of all rows of docs to a new folder.

    Order: doc_id, nulls first; rows with the same id by their texts. A null or empty text has the end id only. Repeated
    rows are written each. Other columns are not looked at. An empty table gives a folder without blocks. The only
    shuffle is the one that brings the texts in order; a task holds one block, and one document, at a time."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(vocabulary, ranks), _Part(TaskContext.get().partitionId(), planes, block)
        end = np.array([end_id], known.dtype)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in part.add(doc_id, np.append(known.ids(text.as_py()), end)):
                    yield pa.RecordBatch.from_pylist([row], BLOCKS)
        if part.ids:
            yield pa.RecordBatch.from_pylist([part.flush()], BLOCKS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(blocks, BLOCKS_SQL).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id)
    and ids_crc32 (of the ids as little-endian unsigned 32-bit integers). Each block is read once, alone; documents that
    lie in several blocks are joined through the checksums of their pieces."""
    return _checked(spark.read.schema(BLOCKS_SQL).parquet(path))


def _checked(blocks: DataFrame) -> DataFrame:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, first, out = from_planes(row["planes"], row["n_ids"], row["kind"]), row["first"], []
                for d in row["docs"]:
                    low, high = max(d["start"], first), min(d["start"] + d["length"], first + row["n_ids"])
                    out.append({"part": row["part"], "ordinal": d["ordinal"], "doc_id": d["doc_id"], "start": d["start"], "n_tokens": d["length"], "low": low - d["start"], "n": high - low, "crc": zlib.crc32(ids[low - first : high - first])})
                yield pa.RecordBatch.from_pylist(out, PIECES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column(4).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = joined_crc32(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crcs, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = blocks.mapInArrow(pieces, "part int, ordinal long, doc_id long, start long, n_tokens long, low long, n long, crc long")
    docs = (
        read.groupBy("part", "ordinal", "doc_id", "start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("low", "n", "crc"))).alias("parts"))
        .select("part", "doc_id", "start", "n_tokens", "parts")
        .mapInArrow(joined, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    )
    # one row per part: as many as the writing had tasks
    ends = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(ends.select("part", before.alias("before")), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame) -> DataFrame:
    """Real contents: part, first, ids of every block, for training readers and for tests."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["first"]], pa.int64()), pa.array([from_planes(row["planes"], row["n_ids"], row["kind"]).tolist()], pa.list_(pa.int64()))], names=["part", "first", "ids"])

    return blocks.mapInArrow(ids, "part int, first long, ids array<long>")


PIECES = pa.schema([(n, pa.int32() if n == "part" else pa.int64()) for n in ("part", "ordinal", "doc_id", "start", "n_tokens", "low", "n", "crc")])
