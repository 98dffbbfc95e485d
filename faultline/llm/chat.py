"""Chat conversations from an event log, rendered reversibly, in DataFrame operations only (op10).

Log rows are conv_id, seq, kind, slot, role, text.  A slot is a message's place.  In the order
of ``seq``, ``message`` starts a slot with role and text, ``delta`` appends text to it, ``edit``
replaces its text, and ``regenerate`` empties it and takes back all later slots.  Folding needs no
state machine: an event is void if a later ``regenerate`` names an earlier slot, or if its own
slot starts over later; what is left of a slot is its last start and the deltas after it.

Template.  A turn is ``### role``, a line break, the text and ``</turn>`` with a line break.  Inside
texts and roles ``\\`` becomes ``\\b``, ``#`` becomes ``\\h`` and ``</turn>`` becomes ``\\l/turn>``
(line breaks of roles ``\\n``), so no marker can occur there and unescaping is exact.  The
loss mask is a list of (start, length) in characters of the formatted text, one per
assistant text.

A slot is folded on its own; only the last step brings the turns of one conversation together,
which is one output row as a document is.

Defined results: null text is empty, null role an empty role; rows of one conversation with
the same turn are ordered by role and text, repeated rows are repeated turns; a delta or edit
without a message makes one with its role; a null conv_id is a conversation of its own; an
empty table gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template's control strings and the escapes for what texts may hold of them.
HEAD, END = "### ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("</turn>", "\\l/turn>")]
LINE = ("\n", "\\n")
ASSISTANT = "assistant"
#: Characters of a streamed delta in a log made from finished rows.
DELTA_CHARS = 200


def escape(text: Column, role: bool = False) -> Column:
    for plain, held in ESCAPES + [LINE] * role:
        text = F.replace(text, F.lit(plain), F.lit(held))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, held in ([LINE] * role + ESCAPES[::-1]):
        text = F.replace(text, F.lit(held), F.lit(plain))
    return text


def log_of_rows(rows: DataFrame) -> DataFrame:
    """Event log of finished rows (conv_id, turn, role, text): assistant texts as a message that
    streams in, others as one message."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    slots = rows.select("conv_id", F.row_number().over(by).cast("long").alias("slot"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    streamed = F.col("role") == ASSISTANT
    parts = F.when(streamed, F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)))
                   ).otherwise(F.array("text"))
    return slots.select("conv_id", "slot", "role", F.posexplode(parts).alias("at", "text")).select(
        "conv_id", (F.col("slot") * F.lit(1 << 32) + F.col("at")).alias("seq"),
        F.when(F.col("at") == 0, "message").otherwise("delta").alias("kind"), "slot", "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, slot, role, text: the messages that the log ends with."""
    later = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    taken_back = F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later)
    own = Window.partitionBy("conv_id", "slot")
    start = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))).over(own)
    live = log.withColumn("back", taken_back).where("back is null or back >= slot").withColumn("start", start)
    text = F.when((F.col("kind") == "regenerate") | (F.col("seq") < F.coalesce("start", "seq")), F.lit("")).otherwise(
        F.coalesce("text", F.lit("")))
    role = F.when(F.col("kind") == "message", F.struct(F.lit(1).alias("said"), "seq", "role")).otherwise(
        F.struct(F.lit(0).alias("said"), "seq", "role"))
    return live.groupBy("conv_id", "slot").agg(
        F.coalesce(F.max(role)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", text.alias("text")))),
                                 lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: the formatted conversations and their masks."""
    said = messages.select("conv_id", "slot", "role", F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit("\n")).alias("head"),
                           escape(F.col("text")).alias("body"))
    turn = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = said.select("conv_id", "slot", turn.alias("turn"), (F.col("role") == ASSISTANT).alias("learned"),
                         (F.coalesce(F.sum(F.char_length(turn)).over(before), F.lit(0)) + F.char_length("head")).alias("start"),
                         F.char_length("body").cast("long").alias("length"))
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slot", "turn", "learned", "start", "length"))).alias("t")) \
        .select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
                F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"], x["length"])).alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``learned`` (texts under the mask), unescaped."""
    raw = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(HEAD) + 1)), True).alias("role"),
                        unescape(F.substr(x, F.char_length(role) + 2)).alias("text"))

    return formatted.withColumn("turns", F.transform(raw, turn)).withColumn("learned", F.transform(
        "loss", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))))


def format_conversations(log: DataFrame, path: str) -> None:
    """Fold the log, render every conversation and write them below ``path``."""
    render(fold(log)).write.mode("overwrite").parquet(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """The written conversations with their turns and the texts under the mask."""
    return parse(spark.read.parquet(path))


def digests(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
