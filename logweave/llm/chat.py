r"""Chat formatting by prefix-target expansion [DataFrame functions only].

A conversation is written once, each turn as ``<s>[ROLE]role[INST]text[/INST]</s>``. Control strings inside
roles and texts are broken by a backslash after their first character, and backslashes are doubled, so no
text can end a turn or begin one, and reading back is exact. Every assistant turn explodes into an example of its own: all
turns before it are its context, written out, and only its text is trainable. Contexts are prefixes of the
conversation's text, cut from it one at a time by bytes; together they are quadratic in a conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[INST]", "[/INST]</s>"
#: What follows the first character of a control string.
_CONTROL = r"(<|\[)(s>|/s>|ROLE\]|INST\]|/INST\])"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_id, its opening, escaped text and whole formatted text, whether it is trained on, its
    place (from 0), and the replies, bytes and characters before it.

    Rows are ordered by turn, then role, then text. Null roles and texts count as empty, null turns come
    first, null conversation ids form one conversation, equal rows are turns of their own. Other columns
    are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    size = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    trained = F.col("role") == TRAINED_ROLE
    return rows.select(
        "conv_id", "head", "body", "piece", trained.alias("trained"),
        (F.row_number().over(own) - 1).alias("place"), size(trained.cast("int")).alias("replies_before"),
        size(F.octet_length("piece")).alias("bytes_before"), size(F.length("piece")).alias("chars_before"),
    )


def explode_examples(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), context_turns, context_chars, context_bytes (of all
    turns before it), context, lead, target.

    context is the text of all turns before it and the opening of this turn, target the escaped text of the reply, on which
    alone is trained. lead is the end of context that the previous example's context and reply do not have. Turns behind a
    conversation's last reply (of one without replies, all) form a row without a target and without numbers, whose
    context is the whole conversation. An empty table gives no rows.
    """
    turns = format_turns(conversations, **columns)
    held = F.struct("place", "piece", "trained", "chars_before", "bytes_before", F.octet_length("head").alias("head_bytes"), F.octet_length("body").alias("body_bytes"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(held)).alias("turns"))
    place = lambda t: F.struct(t["place"].alias("place"), t["chars_before"].alias("chars"), t["bytes_before"].alias("bytes"), (t["bytes_before"] + t["head_bytes"]).alias("open"), t["body_bytes"].alias("size"))
    whole = gathered.select("conv_id", F.array_join("turns.piece", "").cast("binary").alias("whole"), F.transform(F.filter("turns", lambda t: t["trained"]), place).alias("replies"))
    # What is behind the last reply pairs with no reply.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("replies", lambda r: r["open"] + r["size"] + len(CLOSE)))
    parts = whole.select("conv_id", "whole", F.zip_with(starts, "replies", lambda s, r: F.struct(s.alias("start"), r.alias("reply"))).alias("parts"))
    # Of a column alone, since only then Spark compiles the explode and holds one copy of the conversation for all its
    # rows; outer, since otherwise it computes the parts once more to see that there are any.
    rows = parts.select("conv_id", "whole", F.posexplode_outer("parts").alias("example", "part"))
    start, reply, size = F.col("part.start"), F.col("part.reply"), F.octet_length("whole")
    piece = lambda at, n: F.substring("whole", (at + 1).cast("int"), n.cast("int")).cast("string")
    end = F.coalesce(reply["open"], size)
    return rows.where(reply.isNotNull() | (start < size)).select(
        "conv_id", F.col("example").cast("long").alias("example"), reply["place"].alias("context_turns"), reply["chars"].alias("context_chars"), reply["bytes"].alias("context_bytes"),
        piece(F.lit(0), end).alias("context"), piece(start, end - start).alias("lead"), piece(reply["open"], reply["size"]).alias("target"),
    )


def example_texts(examples: DataFrame) -> DataFrame:
    """The training rows: conv_id, example, context, target; only target is to be trained on."""
    return examples.select("conv_id", "example", "context", "target").where("target is not null")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 1)
    body = lambda p: F.regexp_replace(p, r"(?s)^.*?\[INST\]", "")
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What reading a conversation's examples back gives: counts and SHA-256 digests. A conversation becomes one row here.

    Each example's context is read behind what the example before has of it.
    """
    own = F.substring(F.col("context").cast("binary"), (F.octet_length("context") - F.octet_length("lead") + 1).cast("int"), F.octet_length("lead")).cast("string")
    written = F.concat(own, F.coalesce(F.concat("target", F.lit(CLOSE)), F.lit("")))
    read = examples.select("conv_id", "example", written.alias("written"), "target")
    gathered = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "written", "target"))).alias("examples"))
    formatted = F.array_join("examples.written", "")
    targets = F.filter(F.transform("examples", lambda e: e["target"]), lambda t: t.isNotNull())
    read = gathered.select("conv_id", formatted.alias("formatted"), F.array_join(F.transform(targets, unescape), "").alias("loss")).withColumn("turns", read_turns(F.col("formatted")))
    turns, loss = F.col("turns"), F.col("loss")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
