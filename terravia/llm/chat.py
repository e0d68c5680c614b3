"""Preference formatting: the common beginning of two conversations once, then both completions with masks.

Native: higher-order functions over arrays of turns, no Python. A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``. The longest common prefix of turns (equal role and text) is the
prompt; what is left of each conversation is its completion. A mask lists the spans of the completion that
are trained, as ``start-end`` in characters, joined by commas: of each assistant turn the text and
``<|im_end|>\\n`` after it.

Defined results: null roles and texts are empty strings and equal to these; turns are in order of turn,
null turns first, ties by role, then text; rows without a conv_id belong to no conversation and are left
out; equal conversations have empty completions and empty masks; a missing conversation is one without turns; turns that repeat
are turns; an empty table gives no rows; texts of any length are rendered whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both begin with."""
    n = F.least(F.size(a), F.size(b))
    same = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
        )
    )
    differs = F.array_position(same, False)
    return F.coalesce(F.when(differs == 0, n).otherwise(differs - 1), F.lit(0)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    def step(acc, t):
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(t["role"] == "assistant", span).otherwise("")).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of struct<role, text>)."""
    n = F.col("common_turns")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return (
        pairs.withColumn("common_turns", common_turns(F.col("chosen"), F.col("rejected")))
        .withColumns({"head": F.slice("chosen", 1, n), "chosen_rest": rest("chosen"), "rejected_rest": rest("rejected")})
        .select(
            "pair_id", "common_turns", rendered(F.col("head")).alias("prompt"),
            rendered(F.col("chosen_rest")).alias("chosen"), rendered(F.col("rejected_rest")).alias("rejected"),
            mask(F.col("chosen_rest")).alias("chosen_mask"), mask(F.col("rejected_rest")).alias("rejected_mask")
        )
    )


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """A pair of each conversation that has an assistant turn: as it is, and with the last answer (and what
    follows it) replaced by the last answer of its partner (conv_id with the lowest bit changed), or by
    an empty answer where the partner has none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text"))))
    convs = conversations.where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    from_end = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant")
    convs = convs.withColumn("before", F.when(from_end > 0, F.size("turns") - from_end).cast("int")).where("before is not null")
    answers = convs.select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"),
        F.get("turns", F.col("before"))["text"].alias("answer")
    )
    other = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("text")))
    return convs.join(answers, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("before")), other).alias("rejected")
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return format_preferences(preference_pairs(common.table(spark, sf_dir, "conversations")))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(i) AS b FROM t WHERE role = 'assistant' GROUP BY conv_id
), answer AS (
  SELECT t.conv_id, t.text FROM t JOIN last ON t.conv_id = last.conv_id AND t.i = last.b
), turns AS (
  SELECT t.conv_id, 'chosen' AS side, t.i, t.role, t.text FROM t JOIN last USING (conv_id)
  UNION ALL SELECT t.conv_id, 'rejected', t.i, t.role, t.text FROM t JOIN last ON t.conv_id = last.conv_id AND t.i < last.b
  UNION ALL SELECT last.conv_id, 'rejected', last.b, 'assistant', coalesce(answer.text, '') FROM last LEFT JOIN answer ON answer.conv_id = xor(last.conv_id, 1)
), prefix AS (
  SELECT c.conv_id, coalesce(min(c.i) FILTER (WHERE r.role IS NULL OR c.role <> r.role OR c.text <> r.text), count(*)) AS n
  FROM (SELECT * FROM turns WHERE side = 'chosen') c LEFT JOIN (SELECT * FROM turns WHERE side = 'rejected') r ON c.conv_id = r.conv_id AND c.i = r.i
  GROUP BY c.conv_id
), parts AS (
  SELECT turns.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM turns JOIN prefix USING (conv_id)
), spans AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 + length(role) + 1 AS s FROM parts WHERE i >= n
), sides AS (
  SELECT conv_id, side, string_agg(piece, '' ORDER BY i) AS text, coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(text) + 11 AS BIGINT), ',' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM spans GROUP BY conv_id, side
), heads AS (
  SELECT conv_id, string_agg(piece, '' ORDER BY i) AS prompt FROM parts WHERE side = 'chosen' AND i < n GROUP BY conv_id
)
SELECT p.conv_id AS pair_id, CAST(p.n AS INTEGER) AS common_turns, coalesce(h.prompt, '') AS prompt, coalesce(c.text, '') AS chosen, coalesce(r.text, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM prefix p LEFT JOIN heads h ON h.conv_id = p.conv_id LEFT JOIN sides c ON c.conv_id = p.conv_id AND c.side = 'chosen' LEFT JOIN sides r ON r.conv_id = p.conv_id AND r.side = 'rejected'
"""
