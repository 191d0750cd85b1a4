"""Chat formatting by event-sourced reconstruction: a log of streamed deltas, edits and regenerations is folded into
final messages, which are rendered with a template and a loss mask.

A log row is (conv, message, seq, kind, role, body); messages follow each other by number, events by ``seq``:

* ``open`` names the role of a message (the last one counts);
* ``delta`` appends its body;
* ``edit`` replaces the text so far by its body;
* ``regenerate`` drops the text so far, and all that was logged before it for later messages of the conversation.

Everything is SQL: logs are grouped by message, so the events of a hot conversation spread over all tasks.  What a
message loses by the regeneration of an earlier one is a running maximum over narrow rows, first within groups of
GROUP messages, then over the groups.  A conversation is rendered in parts of PART message numbers, so no value grows
with it.

The template is ``<|turn|>role<|text|>text<|end|>``.  A control string inside a role or text gets a backslash after its
first character, and one that has backslashes there already gets one more, so removing one restores the text and no
control string is left inside.  Texts without control strings stay as they are.

Defined results: null roles and bodies are empty; events that are repeated as a whole count once; events of one ``seq``
follow kind, role and body; those without ``seq`` come first; unknown kinds are ignored; a message without a live
event does not exist; null conversations and message numbers are values like others (and come first).  Only the named
columns are read.  An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 4096
PART = 256
DELTA_CHARS = 200
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# First character, backslashes, rest of a control string.
CONTROL_REST = r"(?:\|(?:turn|text|end)\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPE = rf"([<\[])(\\*{CONTROL_REST})"
UNESCAPE = rf"([<\[])\\(\\*{CONTROL_REST})"
KINDS = ("open", "delta", "edit", "regenerate")
LEAST = -(1 << 63)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def logged(messages: DataFrame) -> DataFrame:
    """A log of (conv, message, role, text) as a chat service writes it: texts in deltas of DELTA_CHARS code points.

    By the checksum of the message's key, a quarter is first drafted, followed up and then regenerated, and a quarter is drafted,
    then edited to its first delta and streamed on.
    """
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))

    def event(kind: str, body: Column, later: int = 0, role: Column | None = None) -> Column:
        role = F.lit(None).cast("string") if role is None else role
        return F.struct((F.col("message") + later).alias("message"), F.lit(kind).alias("kind"), role.alias("role"), body.alias("body"))

    no = F.lit(None).cast("string")
    opened = F.array(event("open", no, role=F.col("role")))
    draft = F.array(event("delta", F.upper(F.coalesce(F.get("pieces", F.lit(0)), F.lit("")))))
    follow_up = F.array(event("open", no, 1, F.lit("assistant")), event("delta", F.lit("a reply to the draft"), 1))
    deltas = F.transform("pieces", lambda p: event("delta", p))
    edit = F.array(event("edit", F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))))
    rest = F.transform(F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0))), lambda p: event("delta", p))
    way = F.crc32(F.concat_ws(":", F.col("conv").cast("string"), F.col("message").cast("string"))) % 4
    events = (F.when(way == 0, F.concat(opened, draft, follow_up, F.array(event("regenerate", no)), deltas))
              .when(way == 1, F.concat(opened, draft, edit, rest)).otherwise(F.concat(opened, deltas)))
    rows = messages.select("conv", "message", "role", pieces.alias("pieces")).select(
        "conv", F.col("message").alias("base"), F.posexplode(events).alias("k", "e"))
    return rows.select("conv", "e.message", (F.col("base") * (1 << 20) + F.col("k")).alias("seq"), "e.kind", "e.role", "e.body")


def cutoffs(log: DataFrame) -> DataFrame:
    """(conv, message, cutoff): the last regeneration of an earlier message of the conversation, null where there is none."""
    keys = log.groupBy("conv", "message").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    keys = keys.withColumn("group", F.floor(F.col("message") / GROUP))
    groups = keys.groupBy("conv", "group").agg(F.max("again").alias("again"))
    earlier = Window.partitionBy("conv").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("conv").alias("g_conv"), F.col("group").alias("g_group"), F.max("again").over(earlier).alias("before"))
    inside = Window.partitionBy("conv", "group").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = keys.withColumn("inside", F.max("again").over(inside)).join(
        groups, F.col("conv").eqNullSafe(F.col("g_conv")) & F.col("group").eqNullSafe(F.col("g_group")))
    return rows.select(F.col("conv").alias("c_conv"), F.col("message").alias("c_message"), F.greatest("before", "inside").alias("cutoff"))


def reconstructed(log: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of a log."""
    log = log.where(F.col("kind").isin(*KINDS)).select(
        "conv", "message", F.coalesce("seq", F.lit(LEAST)).cast("long").alias("seq"), "kind", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("body", F.lit("")).alias("body"))
    events = log.groupBy("conv", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "body"))).alias("events"))
    rows = events.join(cutoffs(log), F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("message").eqNullSafe(F.col("c_message")))
    once = F.filter("events", lambda e, i: (i == 0) | (e != F.get("events", i - 1)))
    rows = rows.withColumn("live", F.filter(once, lambda e: F.col("cutoff").isNull() | (e["seq"] > F.col("cutoff"))))
    rows = rows.where(F.size("live") > 0)
    resets = F.filter("live", lambda e: e["kind"].isin("edit", "regenerate"))
    rows = rows.withColumn("reset", F.coalesce(F.get(resets, F.size(resets) - 1)["seq"], F.lit(LEAST)))
    said = F.filter("live", lambda e: (e["seq"] >= F.col("reset")) & e["kind"].isin("delta", "edit"))
    opens = F.filter("live", lambda e: e["kind"] == "open")
    return rows.select("conv", "message", F.coalesce(F.get(opens, F.size(opens) - 1)["role"], F.lit("")).alias("role"),
                       F.array_join(F.transform(said, lambda e: e["body"]), "").alias("text"))


def rendered(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv, part, formatted, loss): ``loss`` lists (start, length) in code points of the texts of role ``learned``."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turns = messages.select("conv", "message", F.floor(F.col("message") / PART).alias("part"), head.alias("head"),
                            escaped(F.col("text")).alias("body"), (F.col("role") == learned).alias("learned"))
    parts = turns.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("message", "head", "body", "learned"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    none = F.array().cast("array<struct<start: long, length: long>>")

    def passed(acc: Column, t: Column) -> Column:
        start, length = acc["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.concat(acc["spans"], F.when(t["learned"], span).otherwise(none)).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return parts.select("conv", "part", formatted.alias("formatted"), F.aggregate("turns", begin, passed)["spans"].alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """(conv, part, turns, learned): the (role, text) of each turn in ``formatted``, and the texts under the loss mask."""
    turns = F.split("formatted", END.replace("|", r"\|"))
    turns = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.substring(t, F.lit(len(TURN) + 1), F.length(t)))
    turns = F.transform(turns, lambda t: F.struct(unescaped(F.substring_index(t, TEXT, 1)).alias("role"),
                                                  unescaped(F.substring_index(t, TEXT, -1)).alias("text")))
    masked = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return output.select("conv", "part", "formatted", turns.alias("turns"), F.transform("loss", lambda s: unescaped(masked(s))).alias("learned"))
