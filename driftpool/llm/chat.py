"""Chat formatting by prefix-target expansion (operator 3, DataFrame functions
only).

Method: every assistant turn becomes an example of its own: all turns before it
are its context, its own text alone is trainable. Turns after a conversation's
last reply form one more example without a trainable part, so that no turn is
lost. An example is one string with the code-point range of its trainable text.

Each turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break.
Inside roles and texts the characters ``<``, ``[`` and ``\\`` get a ``\\`` behind
them, so that no control string of this or another template can occur there, and
reading back takes it away again.

A conversation is gathered once, in one shuffle on its id: an example needs all
its turns in one row. Examples of one conversation grow with the square of its
turns, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpool.llm.common import table

QUERY_NAME = "op3_chat_format"
# fixed values: the template's control strings
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
MARKED, MARK = r"([\\<\[])", r"$1\\"
UNMARK = r"([\\<\[])\\"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, MARK)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNMARK, "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP), escape(text), F.lit(END))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv id, example (from 0), formatted, and loss_start and
    loss_end, the code points from and up to which it is trainable (both the
    string's end where nothing is).

    Rows are ordered by turn (nulls first; ties by role, then text); repeated rows
    are turns of their own. Null roles and texts are empty; rows with a null
    conversation id are one conversation. Other columns are ignored. An empty
    table gives none."""
    none = F.lit("")
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"),
                    F.coalesce(F.col(f"`{role_col}`"), none).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), none).alias("text"))
    convs = df.groupBy(F.col(f"`{conv_col}`").alias("conv")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = convs.select("conv", F.transform("turns", lambda t: F.struct(
        (t.role == TARGET).alias("target"), format_turn(t.role, t.text).alias("all"),
        F.length(escape(t.text)).alias("size"))).alias("parts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at(
        F.col("parts"), i).target | (i == F.size("parts")))
    rows = parts.select("conv", "parts", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("parts", F.col("end"))
    text = F.array_join(F.transform(F.slice("parts", 1, F.col("end")), lambda p: p.all), "")
    rows = rows.select("conv", "example", text.alias("formatted"), last.target.alias("target"),
                       last.size.alias("size"))
    size = F.length("formatted")
    stop = F.when(F.col("target"), size - len(END)).otherwise(size)
    return rows.select(F.col("conv").alias(conv_col), "example", "formatted",
                       (stop - F.when(F.col("target"), F.col("size")).otherwise(0)).alias("loss_start"),
                       stop.alias("loss_end"))


def trainable(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_turns(formatted: Column) -> Column:
    """An example's turns, as an array of (role, text)."""
    split = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(split, lambda x: F.struct(
        unescape(F.substring_index(x, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(x, SEP, -1), END, 1)).alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, read back from the examples."""
    tricky = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ex = examples(turns.union(tricky))
    read = ex.select("conv_id", "example", "formatted", 
                     trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))),
                                 lambda x: x.reply), "").alias("replies"))
    whole = whole.withColumn("turns", read_turns(F.col("longest")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(
        t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("replies").cast("long").alias("loss_chars"),
        F.sha2(F.col("replies").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         33 + length(regexp_replace(role, '([\\<\[])', '\1\1', 'g'))
            + length(regexp_replace(text, '([\\<\[])', '\1\1', 'g')) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM n)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""
