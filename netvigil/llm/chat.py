"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
only that reply is under the loss mask. Turns after the last assistant turn, which no
example would hold, form one further example of the conversation without a target.

Template: a turn is ``<|role|>role<|text|>text<|end|>``. Inside roles and texts ``\\``
becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so that no text can hold a mark; the other
way round is unescaping. ``[INST]`` and ``</s>`` are plain text to this template.

Defined results: a null text or role is empty; turns are ordered by turn (null first),
then role, then text; a null conv_id is a conversation of its own; repeated rows are
turns of their own; no rows give no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """Makes marks inside a text harmless."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text that escape() got: what follows a backslash stands for itself."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, mask_start, mask_chars): mask in characters of formatted, both null without a target."""
    empty = F.lit("")
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("target"),
        F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"),
        escape(t["text"]).alias("body"),
    ))
    shown = whole.select("conv_id", shown.alias("shown"))
    n = F.size("shown")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("shown", k)["target"] | (k == n))
    examples = shown.select("conv_id", "shown", F.posexplode(ends).alias("example", "last"))
    before = F.aggregate(F.slice("shown", 1, F.col("last") - 1), empty, lambda a, t: F.concat(a, t["head"], t["body"], F.lit(END)))
    turn = F.element_at("shown", F.col("last"))
    parts = examples.select("conv_id", "example", before.alias("context"), turn.alias("turn"))
    head = F.concat("context", F.col("turn.head"))
    target = F.col("turn.target")
    return parts.select(
        "conv_id", "example",
        F.concat(head, F.col("turn.body"), F.lit(END)).alias("formatted"),
        F.when(target, F.length(head)).alias("mask_start"),
        F.when(target, F.length(F.col("turn.body"))).alias("mask_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example: array of (role, text), read from the formatted string alone."""
    turns = F.filter(F.split(formatted, r"<\|role\|>"), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.regexp_replace(F.substring_index(x, TEXT, -1), r"<\|end\|>$", "")).alias("text"),
    ))


def read_target(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under an example's mask; null without a target."""
    return unescape(F.substring(formatted, start + 1, chars))


def digests(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its examples."""
    read = examples.select(
        "conv_id", "example", "formatted",
        F.struct("example", read_target(F.col("formatted"), F.col("mask_start"), F.col("mask_chars")).alias("text")).alias("target"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list("target")), lambda t: t["text"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = F.transform(read_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.select(
        "conv_id",
        F.size(read_turns(F.col("longest"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that holds marks, and reads turns and targets back."""
    mark = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", mark), (-1, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(format_chat(given.unionByName(extra)))


#: formatted_chars: each example's turns, their marks (22 characters a turn) and escapes.
OP8_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 AS shown
  FROM given
), running AS (
  SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN so_far ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""
