"""Mixing sources to target weights (operator 3), in DataFrame operations only.

Temperature mixing. A source that holds the share p of all tokens gets the weight p^a / sum(p^a), 0 <= a <= 1. a = 1 keeps
the natural shares, a = 0 makes all sources equal. a is bisected: it is the largest exponent whose weights reach a target
entropy (a fraction of the highest possible one), or, if higher, the smallest exponent at which no source is repeated more
than a limit. Sums over the sources for all midpoints of several levels of the bisection come from one aggregation, so
the table of sources may be of any length and stays distributed.

The budget, unless given, is the least at which the source with the least repetition is used once as a whole: no document
is dropped then. A source is realised as whole permutations (epochs) and one part: in each epoch the blocks of a source
are put in a new order by a hash, and so are the documents of a block. The part takes whole blocks in that order while
they fit into what is left of the source's tokens, then the documents of the first block that does not, while they fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import written

#: Halvings of the exponent's interval, and how many of them one aggregation serves.
HALVINGS, LEVELS = 30, 6
#: Decimals of the exponent: equal sums in another order of addition give the same one.
DECIMALS = 6
#: Tokens of a block at least, and blocks of a source at most.
BLOCK, MOST_BLOCKS = 1 << 12, 1 << 14
TARGET_ENTROPY, MOST_REPEATS = 0.95, 2.0

WORDS = r"[^\x20\x09-\x0D]+"


def _bisected(at, low: float = 0.0, high: float = 1.0) -> float:
    """The end of the interval that `holds` stays true at. at(points) -> {point: True if the answer is at or above it}."""
    for _ in range(HALVINGS // LEVELS):
        points, spans = [], [(low, high)]
        for _ in range(LEVELS):
            spans = [s for a, b in spans for s in ((a, (a + b) / 2), ((a + b) / 2, b))]
            points += [b for _, b in spans[::2]]
        above = at(points)
        for _ in range(LEVELS):
            middle = (low + high) / 2
            low, high = (middle, high) if above[middle] else (low, middle)
    return low


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent for a table of sources with their tokens."""
    known = sources.where("tokens > 0")
    total, k, least, most = known.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not k or k == 1 or least == most:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    target = target_entropy * known.agg(F.log(F.count("*").cast("double"))).first()[0]

    def reaches(points: list[float]) -> dict[float, bool]:
        """Whether the entropy ln(z) - a * e / z of each exponent a is high enough, with z the sum of p^a and e that of p^a ln p."""
        sums = (f for a in points for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))
        row = known.agg(*sums).first()
        return {a: math.log(z) - a * e / z >= target for a, z, e in zip(points, row[::2], row[1::2])}

    by_entropy = 1.0 if reaches([1.0])[1.0] else _bisected(reaches)
    ratio = most / least  # of repeats, the source used least and the one used most differ by ratio^(1 - a)
    by_repeats = 0.0 if ratio <= most_repeats else _bisected(lambda points: {a: ratio ** (1 - a) > most_repeats for a in points})
    return round(max(by_entropy, by_repeats), DECIMALS)


def _hashed(*columns: Column) -> Column:
    """The order that a hash gives; MD5 since other engines have it too."""
    return F.md5(F.encode(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), "UTF-8"))


def targets(rows: DataFrame, *, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """For each source: tokens, its weight, quota (tokens that the budget grants it), epochs, part and n_blocks."""
    sources = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    a = exponent(sources, target_entropy, most_repeats)
    total, most = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    weighed = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(weighed)).first()[0] or 1.0
    share = weighed / F.lit(z)
    repeats = F.pow(F.col("tokens") / F.lit(float(most or 1)), F.lit(a - 1)) if budget is None else share * F.lit(float(budget)) / F.col("tokens")
    quota = F.when(F.col("tokens") > 0, F.floor(F.col("tokens") * repeats + F.lit(1e-6))).otherwise(0).cast("long")
    epochs = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1).cast("int")
    part = F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0)
    blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(F.col("tokens") / BLOCK)))
    return sources.select("source", "tokens", share.alias("weight"), quota.alias("quota")).withColumns({"epochs": epochs, "part": part, "n_blocks": blocks})


def schedule(rows: DataFrame, *, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """rows (doc_id, source, n_tokens and any more), once for each epoch that takes them, with epoch and block.

    A null source is a source of its own, shown as an empty one. Documents without tokens weigh nothing and are kept once
    where their whole source is empty, else as often as their block. Repeated rows are documents each. An empty table
    gives an empty table. No task sees all of a source but a table of its blocks, MOST_BLOCKS at most."""
    goal = targets(rows, target_entropy=target_entropy, most_repeats=most_repeats, budget=budget)
    number = F.conv(F.substring(_hashed(F.col("doc_id")), 1, 7), 16, 10).cast("long")
    dealt = rows.join(goal.select("source", "epochs", "part", "n_blocks"), "source").withColumn("block", (number % F.col("n_blocks")).cast("int"))

    sums = dealt.where("part > 0").groupBy("source", "epochs", "part", "block").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy(_hashed(F.col("source"), F.col("epochs"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("room", F.col("part") - before).where("room >= 0").select("source", "block", "room", (F.col("tokens") <= F.col("room")).alias("whole"))
    found = dealt.join(last, ["source", "block"], "left")

    more = F.when(F.col("whole"), 1).otherwise(0)
    whole = found.withColumn("epoch", F.explode(F.expr("sequence(0, epochs)"))).where(F.col("epoch") < F.col("epochs") + more)
    up_to = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(_hashed(F.col("epochs"), F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = found.where(~F.col("whole")).withColumn("up_to", up_to).where("up_to <= room").withColumn("epoch", F.col("epochs"))
    names = [*rows.columns, "epoch", "block"]
    return whole.select(names).unionByName(cut.select(names))


def counted(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> list[Column]:
    """doc_id, source and n_tokens (words) of documents."""
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens")]


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixture as a schedule: doc_id, source, n_tokens, epoch, block and slot (place in its block, from 0)."""
    rows = written(docs.select(*counted(docs, id_col=id_col, source_col=source_col, text_col=text_col)), "mix-rows")
    slot = F.row_number().over(Window.partitionBy("source", "epoch", "block").orderBy(_hashed(F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens")) - 1
    return schedule(rows, **how).withColumn("slot", slot)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixture as documents: the rows of docs with all their columns, each as often as the mixture takes it."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    return schedule(docs.select(*counted(docs, id_col=id_col, source_col=source_col, text_col=text_col), whole), **how).select("row.*")
