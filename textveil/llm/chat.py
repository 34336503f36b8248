"""Chat formatting (operator 5), in Spark expressions only.

The turns of a conversation are collected as structs and sorted. Adjacent turns of one role are merged into a block: a
turn whose role equals that of the turn before opens no block. A block is

    <|turn|>role LF text (<|and|> text)* <|end|> LF

Texts and roles are escaped so that no control string stands in them: a backslash is doubled, then `<|` becomes `<\\|`,
and in a role a line feed becomes backslash n. Reading back undoes this exactly.

The loss mask is run-length encoded: for each turn the code points before its text, the code points of its text, and
whether the text counts. Each step handles an array once from end to end, so the work is linear in a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AND, END = "<|turn|>", "<|and|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # no escaped text holds `<|`, so codes that begin with it can keep apart what has been read
    read = F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("<|0")), F.lit("<\\|"), F.lit("<|1")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(read, F.lit("<|0"), F.lit("\\")), F.lit("<|1"), F.lit("<|"))


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_runs (array of before, text, loss) of every conversation.

    Turns are ordered by turn, nulls first, then role and text; repeated rows are turns each. A null text or role is
    empty. Rows with a null conv_id form one conversation. Other columns are not looked at. An empty table gives an empty
    table. One conversation is one row, so it has to fit into a task."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, k: Column) -> Column:
        opened = F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"))
        before = F.when(k == 0, opened).when(t["role"] == F.get("turns", k - 1)["role"], F.lit(AND)).otherwise(F.concat(F.lit(END), opened))
        return F.struct(before.alias("before"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("loss"))

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END))
    runs = F.transform("pieces", lambda p: F.struct(F.length(p["before"]).alias("before"), F.length(p["text"]).alias("text"), p["loss"].alias("loss")))
    return pieces.select("conv_id", joined.alias("formatted"), runs.alias("loss_runs"))


def _split(text: Column, mark: str) -> Column:
    return F.split(text, f"\\Q{mark}\\E", -1)


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text and formatted_chars, from formatted and loss_runs alone."""
    blocks = _split(F.col("formatted"), END)

    def of_block(block: Column) -> Column:
        inside = F.substr(block, F.lit(len(OPEN) + 1))
        role = F.substring_index(inside, "\n", 1)
        texts = _split(F.substr(inside, F.length(role) + 2), AND)
        return F.transform(texts, lambda text: F.struct(_unescape_role(role).alias("role"), text.alias("raw")))

    found = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "loss_runs", F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), of_block)).alias("found"))
    turns = F.transform("found", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text")))

    def under_mask(t: Column, k: Column) -> Column:
        run = F.get("loss_runs", k)
        return F.when(run["loss"], unescape(F.substr(t["raw"], F.lit(1), run["text"]))).otherwise("")

    return found.select("conv_id", turns.alias("turns"), F.array_join(F.transform("found", under_mask), "").alias("loss_text"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds, as counts and checksums."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
