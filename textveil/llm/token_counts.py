"""Token counts (operator 1): a two-tier look-up in the map, without any shuffle.

Tier one is a compact table of the lengths, in tokens, of frequent pre-token units. It is counted over a bounded sample
and broadcast; its size is bounded by `most_frequent`. Tier two is each worker's cache: a unit that tier one lacks is
encoded once in a worker and kept. The sample only decides what is looked up and what is encoded, never a result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.tokens import LONGEST_UNIT, TextEncoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Documents looked at for tier one, and the longest of them in bytes: at most 8 MB reach the driver.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 512, 16_384
#: Units in tier one at most: about 1 MB in the broadcast.
MOST_FREQUENT = 1 << 15

_encoders: dict[tuple, TextEncoder] = {}


def frequent_lengths(docs: DataFrame, vocabulary: str, ranks: str | None, *, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = MOST_FREQUENT) -> tuple[str, bytes]:
    """Tier one: the units that occur twice or more in the sample, most frequent first, joined by spaces (no unit holds
    one), and their lengths, a byte each."""
    small = docs.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(text_col).limit(SAMPLE_DOCUMENTS)
    seen = Counter(u for (text,) in small.collect() for u in text.split(" ")[1:] if u and len(u) <= LONGEST_UNIT and not (u[0].isspace() or u[-1].isspace()))
    known = TextEncoder(vocabulary, ranks)
    units = [u for u, n in seen.most_common(most_frequent) if n > 1 and known.lengths[u] < 256]
    return " ".join(units), bytes(known.lengths[u] for u in units)


def token_counts(docs: DataFrame, vocabulary: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    A null or empty text has no bytes and no tokens; a null id stays null; repeated rows are counted each; other columns
    are not looked at; an empty table gives an empty table. A very long text is encoded whole, unit by unit."""
    tier = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, ranks, id_col=id_col, text_col=text_col))
    key = (vocabulary, ranks, hash(tier.value))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:  # kept in the worker process from task to task
            _encoders.clear()
            units, lengths = tier.value
            _encoders[key] = TextEncoder(vocabulary, ranks, lengths=dict(zip(units.split(" "), lengths)) if units else None)
        known = _encoders[key]
        for batch in batches:
            counts = [known.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, SCHEMA)
