"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after each exchange, so one logged
conversation is a prefix of a longer one.  Rolling hashes of turn prefixes
find them: a conversation is kept only if no other one has it as a proper
prefix, and of equal conversations the one with the smallest conv_id is kept.
What is kept is rendered as one string.

The rolling hash of a prefix is the running XOR of two independent 64-bit
hashes of (position, role, text); with the prefix length that is a 128-bit
key, and it grows from turn to turn without carrying the text along.

Skew: prefixes and whole conversations are reduced to distinct keys (with
map-side partial aggregation) before the anti-join, so a first turn that a
third of all conversations share is one row there.  Turns of one conversation
meet in one task because its rendering is one value.

Defined results: turns are ordered by (turn, role, text), nulls first, and a
row that repeats another one of the same conversation wholly counts once; a
null role is rendered as ``unknown`` and a null text as empty; ``<|`` inside a
text is written ``< |`` so that no text can forge a turn border; rows with a
null conv_id belong to no conversation and give nothing; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import read_table

ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _clean(conversations: DataFrame) -> DataFrame:
    """One row per distinct turn, with what is rendered and its position."""
    turns = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(
            "conv_id",
            "turn",
            F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = (F.lag("turn").over(order).eqNullSafe(F.col("turn"))) & (F.lag("role").over(order) == F.col("role")) & (F.lag("text").over(order) == F.col("text"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = turns.withColumn("again", F.coalesce(same, F.lit(False))).where(~F.col("again")).drop("again")
    return fresh.withColumn("pos", F.row_number().over(order).cast("long")).withColumn(
        "h1", F.bit_xor(F.xxhash64("pos", "role", "text")).over(running)
    ).withColumn("h2", F.bit_xor(F.xxhash64(F.lit(7919), "text", "role", "pos")).over(running))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of those that are no proper prefix of another one and
    have no equal with a smaller conv_id."""
    steps = _clean(conversations).select("conv_id", "pos", "h1", "h2")
    last = Window.partitionBy("conv_id")
    steps = steps.withColumn("n_turns", F.max("pos").over(last))
    whole = steps.where("pos = n_turns").groupBy(F.col("pos").alias("n_turns"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = steps.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit(ROLE_CLOSE), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(TURN_CLOSE))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    kept = maximal_conversations(conversations)
    turns = (
        conversations.select("conv_id", "turn", "role", "text")
        .join(kept, "conv_id")
        .select(
            "conv_id",
            "n_turns",
            F.struct(
                "turn",
                F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            ).alias("t"),
        )
    )
    lines = F.transform(F.array_sort(F.array_distinct(F.collect_list("t")), lambda a, b: _compare(a, b)), lambda t: rendered_turn(t["role"], t["text"]))
    return turns.groupBy("conv_id", "n_turns").agg(F.array_join(lines, "").alias("rendered"))


def _compare(a: Column, b: Column) -> Column:
    """Order of (turn, role, text) with null turns first."""
    def less(name: str) -> Column:
        return F.when(a[name].isNull() & b[name].isNull(), F.lit(0)).when(a[name].isNull(), F.lit(-1)).when(b[name].isNull(), F.lit(1)).when(a[name] < b[name], F.lit(-1)).when(a[name] > b[name], F.lit(1)).otherwise(F.lit(0))

    by_turn, by_role = less("turn"), less("role")
    return F.when(by_turn != 0, by_turn).when(by_role != 0, by_role).otherwise(less("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, min(n) AS n_turns FROM steps WHERE pos = n GROUP BY prefix
), kept AS (
  SELECT conv_id, n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.pos < s.n AND s.prefix = w.prefix)
)
SELECT k.conv_id, k.n_turns,
       string_agg('<|im_start|>' || replace(c.role, '<|', '< |') || chr(10) || replace(c.text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY c.turn NULLS FIRST, c.role, c.text) AS rendered
FROM kept k JOIN clean c USING (conv_id)
GROUP BY k.conv_id, k.n_turns
"""

QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {"op3_chat_format": ORACLE}
