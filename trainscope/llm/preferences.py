"""Preference formatting of chosen and rejected conversations, with Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import table

# How a turn is rendered.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, as an array of role and text.

    Equal turn numbers (also null ones, which come first) go by role, then by text; repeated rows stay.
    A null role or text counts as empty.  Rows without ``conv_id`` belong to no conversation.
    """
    ordered = F.sort_array(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return (turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
            .agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BETWEEN), turn["text"], F.lit(CLOSE))


def _from(turns: Column, start: Column) -> Column:
    return F.slice(turns, start + 1, F.greatest(F.size(turns) - start, F.lit(0)))


def _spans(turns: Column) -> Column:
    """First and end character of what is trained on: the text and the end mark of each trained turn."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        end = (acc["at"] + F.length(_render(turn))).cast("int")
        first = (end - F.length(turn["text"]) - len(CLOSE)).cast("int")
        own = F.array(F.struct(first.alias("first"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, add, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """All columns of ``pairs`` but ``chosen`` and ``rejected`` (arrays of role and text), and what training needs.

    ``n_common`` is the length of the longest common prefix of turns, ``prompt`` that prefix rendered
    once.  ``chosen`` and ``rejected`` are the two rests rendered, and ``chosen_mask`` and
    ``rejected_mask`` the spans of characters in them that count for the loss: text and end mark of
    assistant turns.  Equal conversations have two empty completions; a null conversation counts as
    one without turns.
    """
    turns = "array<struct<role:string,text:string>>"
    pairs = pairs.withColumns({c: F.coalesce(c, F.array().cast(turns)) for c in ("chosen", "rejected")})
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~F.get("chosen", i).eqNullSafe(F.get("rejected", i)))
    common = F.when(shorter == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), shorter))
    cut = pairs.withColumn("n_common", common.cast("int"))
    rest = {c: _from(F.col(c), F.col("n_common")) for c in ("chosen", "rejected")}
    joined = {c: F.array_join(F.transform(t, _render), "") for c, t in rest.items()}
    return cut.select(
        *(c for c in pairs.columns if c not in ("chosen", "rejected", "n_common", "prompt", "chosen_mask", "rejected_mask")), "n_common",
        F.array_join(F.transform(F.slice("chosen", 1, F.col("n_common")), _render), "").alias("prompt"),
        joined["chosen"].alias("chosen"), _spans(rest["chosen"]).alias("chosen_mask"),
        joined["rejected"].alias("rejected"), _spans(rest["rejected"]).alias("rejected_mask"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """A pair ``(conv_id, chosen, rejected)`` for each conversation.

    The chosen side is the conversation.  The rejected one keeps its turns before the last assistant
    turn and ends as the partner does from its last assistant turn on; conversations 2n and 2n + 1 are
    partners.  Without a partner, or an assistant turn in it, nothing follows.
    """
    own = conversations(turns)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), TRAINED)
    last = F.when(F.exists("turns", lambda t: t["role"] == TRAINED), last).otherwise(F.size("turns"))
    own = own.withColumn("last", last.cast("int"))
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), _from(F.col("turns"), F.col("last")).alias("reply"))
    kept = F.slice("turns", 1, F.col("last"))
    reply = F.coalesce("reply", F.array().cast("array<struct<role:string,text:string>>"))
    return own.join(other, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), F.concat(kept, reply).alias("rejected"))


def op1_preference_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation against its start with another reply; masks as text."""
    done = format_preferences(reply_pairs(table(spark, sf_dir, "conversations")))
    for c in ("chosen_mask", "rejected_mask"):
        done = done.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","))
    return done


SQL = """
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id,
         list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
l AS (
  SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns) + 1) AS last FROM c),
p AS (
  SELECT a.conv_id, a.turns AS chosen, list_concat(a.turns[1:a.last - 1], coalesce(b.turns[b.last:], [])) AS rejected
  FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
                                          lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                     least(len(chosen), len(rejected))) AS n_common
  FROM p),
r AS (
  SELECT conv_id, n_common, list_transform(chosen, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS c_text,
         list_transform(rejected, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS r_text, chosen, rejected
  FROM n),
s AS (
  SELECT conv_id, n_common, list_aggregate(c_text[1:n_common], 'string_agg', '') AS prompt,
         c_text[n_common + 1:] AS c_text, r_text[n_common + 1:] AS r_text,
         chosen[n_common + 1:] AS chosen, rejected[n_common + 1:] AS rejected
  FROM r),
e AS (
  SELECT *, list_transform(range(1, len(c_text) + 1), lambda i: CAST(list_sum(list_transform(c_text[1:i], lambda x: length(x))) AS BIGINT)) AS c_end,
         list_transform(range(1, len(r_text) + 1), lambda i: CAST(list_sum(list_transform(r_text[1:i], lambda x: length(x))) AS BIGINT)) AS r_end
  FROM s)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt,
       coalesce(list_aggregate(c_text, 'string_agg', ''), '') AS chosen,
       coalesce(list_aggregate(list_transform(list_filter(range(1, len(c_text) + 1), lambda i: chosen[i].role = 'assistant'),
         lambda i: CAST(c_end[i] - length(chosen[i].text) - 8 AS VARCHAR) || '-' || CAST(c_end[i] AS VARCHAR)), 'string_agg', ','), '') AS chosen_mask,
       coalesce(list_aggregate(r_text, 'string_agg', ''), '') AS rejected,
       coalesce(list_aggregate(list_transform(list_filter(range(1, len(r_text) + 1), lambda i: rejected[i].role = 'assistant'),
         lambda i: CAST(r_end[i] - length(rejected[i].text) - 8 AS VARCHAR) || '-' || CAST(r_end[i] AS VARCHAR)), 'string_agg', ','), '') AS rejected_mask
FROM e
"""
