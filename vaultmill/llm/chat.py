"""Preference formatting of paired conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and
text) is rendered once, as the prompt; the turns after it are rendered as two completions. In a
completion only what the assistant says is trained on: the mask lists the character ranges
"from:to" of assistant turns, header left out, end mark included.

The prefix is found without putting turns side by side in one place: turns are numbered within their
conversation, matched by (pair, number), and the first number that differs is a minimum over the
pair. Turns are gathered per conversation only to write its text, which is one output row by nature.

The corpus' conversations have no pair ids: conversation 2k is taken as chosen, 2k + 1 as rejected.
Conversations without partner and rows without conversation id are in no pair. Turns are ordered by
turn number (null last), then role and text; repeated rows are turns of their own. Null roles and
texts are rendered as empty, and equal only to null. If one conversation is a prefix of the other
its completion is empty. Empty input: empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.llm.common import table


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preferences(turns: DataFrame) -> DataFrame:
    """turns(pair, side, turn, role, text), side 0 chosen and 1 rejected -> one row per complete pair:
    pair, shared_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    t = turns.where("pair is not null and side in (0, 1)")
    order = W.partitionBy("pair", "side").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    t = t.select("pair", "side", F.row_number().over(order).alias("i"), "role", "text")
    # one row per (pair, number): the two turns with that number agree or not
    key = F.struct(F.col("role").isNull().alias("rn"), F.col("role").alias("r"), F.col("text").isNull().alias("tn"), F.col("text").alias("t"))
    level = t.groupBy("pair", "i").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b"), F.max("side").alias("hi"), F.min("side").alias("lo"))
    cut_at = level.groupBy("pair").agg(
        F.coalesce(F.min(F.when((F.col("n") < 2) | ~F.col("a").eqNullSafe(F.col("b")), F.col("i"))), F.max("i") + 1).alias("first"), F.max("hi").alias("hi"), F.min("lo").alias("lo")
    )
    t = t.join(cut_at.where("hi > lo").select("pair", "first"), "pair")
    done = F.col("i") >= F.col("first")
    t = t.where(done | (F.col("side") == 0)).select("pair", "first", F.when(done, F.col("side")).otherwise(-1).alias("part"), "i", "role", rendered(F.col("role"), F.col("text")).alias("s"))
    before = W.partitionBy("pair", "part").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)))
    start = F.col("at") + F.length("role") + 5
    mask = F.when(F.col("role") == "assistant", F.concat(start.cast("string"), F.lit(":"), (F.col("at") + F.length("s") - 1).cast("string")))
    lines = lambda part, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("i", what.alias("s"))))), lambda x: x["s"])
    out = t.withColumn("mask", mask).groupBy("pair").agg(
        (F.max("first") - 1).cast("long").alias("shared_turns"),
        F.array_join(lines(-1, F.col("s")), "").alias("prompt"),
        F.array_join(lines(0, F.col("s")), "").alias("chosen"),
        F.array_join(lines(1, F.col("s")), "").alias("rejected"),
        F.array_join(lines(0, F.col("mask")), ",").alias("chosen_mask"),
        F.array_join(lines(1, F.col("mask")), ",").alias("rejected_mask"),
    )
    return out


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pair, side = F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)).cast("int")
    return preferences(c.select(pair.alias("pair"), side.alias("side"), "turn", "role", "text"))


OP2_SQL = r"""
WITH t AS (
  SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair, ((conv_id % 2) + 2) % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair FROM t GROUP BY pair HAVING count(DISTINCT side) = 2),
m AS (
  SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair = b.pair AND a.i = b.i),
f AS (SELECT pair, coalesce(min(CASE WHEN NOT same THEN i END), max(i) + 1) AS first FROM m WHERE pair IN (SELECT pair FROM p) GROUP BY pair),
r AS (
  SELECT t.pair, f.first, CASE WHEN i >= first THEN side ELSE -1 END AS part, i, role,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s
  FROM t JOIN f ON t.pair = f.pair WHERE i >= first OR side = 0),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT pair, (max(first) - 1)::BIGINT AS shared_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (part = -1), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (part = 0), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (part = 1), '') AS rejected,
  coalesce(string_agg((pos + length(role) + 5)::VARCHAR || ':' || (pos + length(s) - 1)::VARCHAR, ',' ORDER BY i) FILTER (part = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((pos + length(role) + 5)::VARCHAR || ':' || (pos + length(s) - 1)::VARCHAR, ',' ORDER BY i) FILTER (part = 1 AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair
"""
