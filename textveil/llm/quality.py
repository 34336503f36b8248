"""Quality rules (operator 7), in DataFrame operations only.

Base rules count words, symbols, repeated lines and words in repeated windows, and reject documents that are too short or
too repetitive. The verdict on the others is a log-likelihood ratio: words and pairs of adjacent words are hashed to a
fixed number of buckets; two multinomials over the buckets are counted, one over trusted documents and one over the whole
raw corpus; a document's score is the mean, over all its n-grams, of

    ln((trusted[b] + PRIOR) / (expected[b] + PRIOR)),   expected[b] = raw[b] * sum(trusted) / sum(raw)

so a bucket that is as common among trusted documents as in the corpus, or too rare to tell, adds nothing. A document is
kept if its score is at least `threshold`. The ratios are a table of 2 * BUCKETS rows, whatever the corpus, and so are
broadcast. Texts are not shuffled: only one row per document and one per bucket and task are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated; fewest words; most repeated words in a hundred.
WINDOW, FEWEST, MOST_REPEATED = 8, 20, 30
#: Buckets for words, and as many for pairs.
BUCKETS = 1 << 15
PRIOR = 10.0
THRESHOLD = -0.08
#: Trusted documents that the target is counted over: those whose ids hash lowest.
TRUSTED = 1 << 14


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of at most `most` documents labelled as good and not toxic: a bounded sample of labelled rows."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8")), "doc_id").limit(most)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: row, doc_id, the base counts, and grams, the buckets of its n-grams.

    An array that a lambda looks into is a column of its own, or it would be made anew for each element."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.xxhash64(text).alias("text")).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(WORDS)))
    rows = rows.select("row", "doc_id", F.regexp_extract_all("text", F.lit(WORDS), 0).alias("words"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.crc32(F.encode(w, "UTF-8"))).alias("crc"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hash"),
    )
    last = F.size("hash") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(*(F.get("hash", k + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(F.size("crc") > 1, F.transform(F.sequence(F.lit(0), F.size("crc") - 2), lambda k: (F.lit(BUCKETS) + (F.get("crc", k) * 31 + F.get("crc", k + 1)) % BUCKETS).cast("int"))).otherwise(F.array().cast("array<int>"))
    grams = F.concat(F.transform("crc", lambda c: (c % BUCKETS).cast("int")), pairs)
    base = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(*base, windows.alias("windows"), grams.alias("grams"))
    # windows that occur twice or more, by sorting them with their places; most documents have none and skip this
    sorted_ = F.sort_array(F.transform("windows", lambda w, k: F.struct(w.alias("w"), k.alias("k"))))
    rows = rows.select(*base, "grams", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_).alias("sorted"))
    def same(place: Column, x: Column) -> Column:
        return F.get("sorted", place)["w"].eqNullSafe(x["w"])

    again = F.transform("sorted", lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["k"]))
    rows = rows.select(*base, "grams", F.sort_array(F.filter(again, lambda k: k.isNotNull())).alias("starts"))
    covered = F.transform("starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - at, F.lit(WINDOW))))
    return rows.select(*base, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda n, c: n + c), F.lit(0).cast("long")).alias("n_repeat_words"), "grams")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratios(measured: DataFrame, trusted: DataFrame, prior: float = PRIOR) -> DataFrame:
    """bucket and ratio: a row for each bucket that the corpus uses, 2 * BUCKETS at most."""
    flagged = measured.select("doc_id", "grams").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    # outer: the filter that Spark derives from a plain explode would make the arrays once more for each of their elements
    counts = flagged.select(F.explode_outer("grams").alias("bucket"), "good").where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("trusted"))
    kind = (F.col("bucket") >= BUCKETS).alias("pairs")
    sums = counts.groupBy(kind).agg(F.sum("raw").alias("all_raw"), F.sum("trusted").alias("all_trusted"))
    expected = F.col("raw") * F.col("all_trusted") / F.col("all_raw")
    return counts.withColumn("pairs", kind).join(F.broadcast(sums), "pairs").select("bucket", F.log((F.col("trusted") + prior) / (expected + prior)).alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row of docs.

    trusted: doc_ids of a bounded number of good documents (see trusted_ids); with none, every ratio is 0. A null text
    has no words; without words the score is 0. Repeated rows are judged each, and alike; other columns are not looked
    at; an empty table gives an empty table."""
    return _judged(docs, trusted, id_col, text_col, threshold, prior).drop("text_key")


def _judged(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    measured = _measured(docs, id_col, text_col)
    table = ratios(measured, trusted, prior)
    spread = measured.select("row", "doc_id", *BASE, F.explode_outer("grams").alias("bucket"))
    scored = spread.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", *BASE).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))
    return scored.select("doc_id", F.col("row.text").alias("text_key"), *BASE, base_failed().alias("base_failed"), "score", (~base_failed() & (F.col("score") >= threshold)).alias("kept"))


def kept_documents(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows that share an id, or have none, are told apart by
    their texts."""
    gone = _judged(docs, trusted, id_col, text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")) & (text == F.col("__text")), "left_anti")
