"""Chat formatting with Spark expressions only.

Template: each run of adjacent turns of one role is a block
``<|start|>role<|text|>first<|next|>second<|end|>``. Inside roles and texts a backslash goes
before every backslash and into every control string, so that none is left; dropping each
backslash and keeping what follows it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import table

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: Openings of control strings of this and other common templates, cut by a backslash after their first character.
_CONTROL = r"(<(?=\||/?s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\[(?=/?INST\]))"


def escaped(text):
    """``text`` without any control string; null is empty."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text):
    """The inverse of ``escaped``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted (string), segments (array of (text, loss)).

    ``rows`` has conv_id, turn, role, text. Turns are sorted by (turn, role, text), so ties and
    repeated rows have a fixed order and all stay; null turns come first; null roles and texts
    count as empty; rows whose conv_id is null form one conversation; an empty table gives an
    empty result; other columns are not carried. ``segments`` concatenate to ``formatted``;
    loss is true on the texts of the roles in ``learn``, one segment for each turn. All turns of
    a conversation meet in one row, as the formatted conversation is one value.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    c = rows.groupBy(F.col("conv_id").alias("conv_id")).agg(turns.alias("t"))
    # where a run of one role starts, and the turns of each run
    n = F.size("t")
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    c = c.select("conv_id", "t", firsts.alias("firsts"))
    run = F.transform("firsts", lambda first, k: F.slice("t", first + 1, F.coalesce(F.get("firsts", k + 1), n) - first))

    def block(run):
        learned = F.get(run, 0)["role"].isin(*learn)
        head = F.concat(F.lit(START), escaped(F.get(run, 0)["role"]), F.lit(TEXT))
        lead = lambda i: F.when(i == 0, head).otherwise(F.lit(NEXT))
        pieces = F.transform(run, lambda t, i: F.array(F.struct(lead(i).alias("text"), F.lit(False).alias("loss")), F.struct(escaped(t["text"]).alias("text"), learned.alias("loss"))))
        return F.concat(F.flatten(pieces), F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))

    c = c.select("conv_id", run.alias("runs")).select("conv_id", F.flatten(F.transform("runs", block)).alias("segments"))
    return c.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed_chat(formatted):
    """Turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda b: b != "")

    def turns(block):
        halves = F.split(F.replace(block, F.lit(END), F.lit("")), r"<\|text\|>", -1)
        return F.transform(F.split(F.get(halves, 1), r"<\|next\|>", -1), lambda t: F.struct(unescaped(F.get(halves, 0)).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    c = format_chats(rows.unionByName(extra)).select("conv_id", "formatted", "segments", parsed_chat(F.col("formatted")).alias("turns"))
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    c = c.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), lost.alias("lost"))
    return c.select(
        "conv_id", "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Turns, digests and counts from the table alone. The formatted length follows from the template: each text
#: with its escapes, a head and an end for each run, a separator inside runs.
OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS head,
    regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS safe_text,
    replace(role, '\', '\\') AS safe_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe_text) + CASE WHEN head = 1 THEN 9 + length(safe_role) + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
