"""Chat formatting with relational expressions only.

A conversation's turns are collected as structs, sorted, and laid out as blocks of
adjacent turns of one role::

    <|im_start|>role<|im_msg|>text<|im_sep|>text of the next turn, same role<|im_end|>

The joint ``<|im_sep|>`` keeps merged turns apart, so they can be read back.  A
control string inside a role or text gets one backslash after its first
character; one that has backslashes there already gets one more.  This is undone
exactly, and no text can open or close a turn.  The loss mask is a list of
[start, end) code points of the formatted text: each text of the trained role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrays import cut, let, pieces, sums_before

START, MESSAGE, JOINT, END = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>"
#: Inside texts also the marks of other common templates are escaped.
_CONTROL = r"([<\[])(\\*)(\|im_(?:start|msg|sep|end)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|endoftext\|>)"
_ESCAPED = r"([<\[])\\(\\*)(\|im_(?:start|msg|sep|end)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|endoftext\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start,end>>.

    ``turns`` has conv_id, turn, role, text; other columns are left out.  Null roles
    and texts count as empty.  Rows that share a turn number are all kept, ordered by
    role and text; a null turn number comes first.  A null conv_id is one
    conversation.  No turns, no rows.  A conversation is one row, of a size that its own
    turns bound; the time that it takes is in proportion to them.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    none = F.array(F.lit(None).cast("string"))

    def beside(roles: Column) -> Column:
        # by shifted arrays: one that a lambda takes by position may be worked out for each element
        before = F.concat(none, F.slice(roles, 1, F.size(roles) - 1))
        after = F.concat(F.slice(roles, 2, F.size(roles) - 1), none)
        return F.zip_with(before, after, lambda a, b: F.struct(a.alias("before"), b.alias("after")))

    def lay(x: Column, by: Column) -> Column:
        return F.struct(
            F.when(x["role"].eqNullSafe(by["before"]), F.lit(JOINT))
            .otherwise(F.concat(F.lit(START), escape(x["role"]), F.lit(MESSAGE)))
            .alias("head"),
            escape(x["text"]).alias("body"),
            F.when(x["role"].eqNullSafe(by["after"]), F.lit("")).otherwise(F.lit(END + "\n")).alias("tail"),
            (x["role"] == trained_role).alias("loss"),
        )

    laid = gathered.withColumn("s", F.zip_with("t", let(F.transform("t", lambda x: x["role"]), beside), lay))
    formatted = F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    sizes = F.transform("s", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"]))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["head"])
        return F.struct(x["loss"].alias("loss"), start.cast("long").alias("start"), (start + F.length(x["body"])).cast("long").alias("end"))

    spans = F.filter(F.zip_with("s", "at", span), lambda x: x["loss"])
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    placed = laid.withColumn("at", sums_before(sizes))
    return placed.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        texts = F.split(F.substring_index(b, MESSAGE, -1), r"<\|im_sep\|>")
        said = unescape(F.substring_index(F.substring_index(b, MESSAGE, 1), START, -1))
        return let(said, lambda role: F.transform(texts, lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    texts = lambda parts: F.transform(spans, lambda s: unescape(cut(parts, s["start"].cast("int"), s["end"].cast("int"))))
    return F.array_join(let(pieces(formatted), texts), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them alone."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
