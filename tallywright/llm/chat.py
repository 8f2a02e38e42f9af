"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role are merged into one block by array functions, and blocks are
concatenated. The template of a block is `[INST]role[/INST]text<turn>text</s>`: a block opens with its role, `<turn>` stands between
the merged turns, `</s>` closes it. Control strings inside texts and roles are written as a backslash and a letter (a backslash
itself as `\\s`), so formatting can be undone exactly: `turns_of` reads the turns back, `loss_texts` the texts under the loss mask.

A conversation is one formatted value, so its turns meet in one task; that is bounded by the conversation, not by the table.

Defined cases: a null text or role counts as empty; a null conv_id is a conversation of its own; turns with equal numbers stand in
the order of role, then text, null numbers first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SHUT, TURN, END = "[INST]", "[/INST]", "<turn>", "</s>"
#: What stands for a control string inside a text. The backslash comes first, so that no other mark is taken for it.
ESCAPES = (("\\", "\\s"), (OPEN, "\\o"), (SHUT, "\\c"), (TURN, "\\t"), (END, "\\e"), ("<s>", "\\b"))


def escape(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation. A span is (start, length) in code points, start from 0."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def lead(t: Column, i: Column) -> Column:
        """What stands before the text of turn i: a new block, or a mark inside the block of its neighbour."""
        new = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT))
        return (F.when(i == 0, new).when(F.col("turns")[i - 1]["role"] == t["role"], F.lit(TURN)).otherwise(F.concat(F.lit(END), new)))

    pieces = F.transform("turns", lambda t, i: F.struct(lead(t, i).alias("lead"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["lead"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((start + F.length(p["body"])).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return rows.withColumn("pieces", pieces).select(
        "conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("pieces", empty, walk)["spans"].alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def of(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), SHUT, 1))
        texts = F.split(F.substring(block, F.lit(1) + F.instr(block, SHUT) - 1 + len(SHUT), F.length(block)), TURN, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """array<string>: the unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_conversations(turns.unionByName(probe))
    read = out.withColumn("back", turns_of(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last_role,
           replace(replace(replace(replace(replace(replace(text, '\', '\s'), '[INST]', '\o'), '[/INST]', '\c'), '<turn>', '\t'), '</s>', '\e'), '<s>', '\b') AS body,
           replace(replace(replace(replace(replace(replace(role, '\', '\s'), '[INST]', '\o'), '[/INST]', '\c'), '<turn>', '\t'), '</s>', '\e'), '<s>', '\b') AS who
    FROM t),
g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(length(body) + CASE WHEN last_role IS NULL THEN 13 + length(who) WHEN last_role = role THEN 6 ELSE 17 + length(who) END) + 4 AS formatted_chars
    FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
"""
