"""Chat formatting as a relational job: Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns
of one role become one block, and blocks are concatenated:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

``<|im_sep|>`` stands between the turns that were merged, so that they can be told
apart again. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (a line feed in a role becomes ``\\n``), so no control string can appear in
them and the escape is undone without loss. The loss mask is a list of spans of
code points, one for the text of each assistant turn.

One conversation becomes one string, so it has to fit in a task, as any row has;
nothing larger is ever collected.

Defined cases: null texts and roles count as empty; equal (conversation, turn)
pairs are ordered by role and text; a null turn comes first; a null conversation
id is a conversation of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """``\\n`` is a line feed only where its backslash isn't the second of a pair."""
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss array<struct<at int, chars int>> (``at`` from 1)
    from rows (conv_id, turn, role, text)."""
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    marked = sorted_turns.select(
        "conv_id",
        F.transform(
            "t",
            lambda x, i: F.struct(
                x["role"].alias("role"),
                escaped(x["text"]).alias("body"),
                F.when((i > 0) & (F.get(F.col("t"), i - 1)["role"] == x["role"]), F.lit(SEP))
                .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(empty), F.lit(START), escaped_role(x["role"]), F.lit("\n")))
                .alias("head"),
            ),
        ).alias("p"),
    )
    # The lengths run along the pieces; one pass keeps the running end and the spans of the learnt role.
    step = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,chars:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["end"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
            F.when(
                x["role"] == learn_role,
                F.concat(acc["spans"], F.array(F.struct((acc["end"] + F.length(x["head"]) + 1).alias("at"), F.length(x["body"]).alias("chars")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), ""), F.lit(END))
    return marked.select("conv_id", text.alias("formatted"), step.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of the template."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**30)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(F.substr(b, F.position(F.lit("\n"), b) + 1), r"<\|im_end\|>\n\z", ""), r"<\|im_sep\|>"),
                lambda x: F.struct(unescaped_role(F.substring_index(b, "\n", 1)).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["at"], s["chars"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of :func:`format_conversations`."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (
  SELECT *, row_number() OVER w AS rn, coalesce(lag(role) OVER w = role, false) AS joined
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + CASE WHEN joined THEN length('<|im_sep|>')
           ELSE length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length('<|im_end|>') + 1 END AS chars
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
