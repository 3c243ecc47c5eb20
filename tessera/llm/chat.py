"""Chat formatting: logged snapshots of one growing conversation collapse to the longest before rendering.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: The rendering of a turn; ``{role}`` and ``{text}`` are replaced.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
#: Turn numbers that one window task orders; a conversation of more turns is spread over several.
STRIDE = 512


def _segment(template: str, role: str, text: str):
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), F.coalesce(F.col(role).cast("string"), F.lit("")), F.lit(between), F.coalesce(F.col(text), F.lit("")), F.lit(after))


def prefixes(turns: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Adds to distinct turns (conv, turn, h1, h2, chars): ``pos`` from 1, the prefix hashes ``p1`` and ``p2`` and the ``start`` character.

    Each is a running value over a conversation; it is made within strides of turn numbers and carried over them, so
    a task holds the rows of a stride, and then a row per stride.
    """
    # xor of hashes of (position, turn) is a rolling hash that windows can run and that cannot overflow.
    part = turns.withColumn("stride", F.coalesce(F.floor(F.col("turn") / stride), F.lit((1 << 62))))
    order = [F.col("turn").asc_nulls_last(), "h1", "h2"]
    size = part.groupBy("conv", "stride").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    before = Window.partitionBy("conv").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("conv", "stride", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    own = Window.partitionBy("conv", "stride").orderBy(*order)
    run = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("i", F.row_number().over(own)).withColumn("cc", F.sum("chars").over(run))
    part = part.join(size, ["conv", "stride"]).withColumn("pos", F.col("i") + F.col("n0")).withColumn("start", F.col("cc") - F.col("chars") + F.col("c0"))
    part = part.withColumn("x1", F.xxhash64("pos", "h1", "h2")).withColumn("x2", F.xxhash64(F.lit(7), "h2", "pos", "h1"))
    fold = part.groupBy("conv", "stride").agg(F.bit_xor("x1").alias("f1"), F.bit_xor("x2").alias("f2"))
    fold = fold.select("conv", "stride", *(F.coalesce(F.bit_xor(f"f{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    part = part.withColumn("r1", F.bit_xor("x1").over(run)).withColumn("r2", F.bit_xor("x2").over(run)).join(fold, ["conv", "stride"])
    return part.select("conv", "turn", "h1", "h2", "chars", "pos", "start", F.expr("r1 ^ b1").alias("p1"), F.expr("r2 ^ b2").alias("p2"))


def format_conversations(
    conversations: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", template: str = TEMPLATE, stride: int = STRIDE
) -> DataFrame:
    """Maximal conversations, rendered: a row per turn with ``conv_id``, ``pos`` (from 1), ``n_turns``, ``n_copies``, ``role``, ``start`` and ``rendered``.

    ``rendered`` begins at character ``start`` of the conversation, so a conversation is its segments in order; no
    task or row ever holds a whole one.  A conversation goes if its turns (role and text) begin a longer one; of equal ones the
    smallest id stays, and ``n_copies`` tells how many there were.  Turns are ordered by number, nulls last, ties by
    hash; rows that repeat conversation, number, role and text count once.  Null roles and texts differ from empty
    ones in comparison and are rendered empty.  Rows without a conversation id belong to none and are left out.  An
    empty table gives no rows; other columns are not used.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text")).where("conv is not null")
    told = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rows = rows.withColumn("h1", F.xxhash64(*told)).withColumn("h2", F.xxhash64(F.lit(11), *reversed(told))).withColumn("rendered", _segment(template, "role", "text"))
    slim = rows.select("conv", "turn", "h1", "h2", F.length("rendered").cast("bigint").alias("chars")).distinct()
    at = prefixes(slim, stride)
    # A row per conversation: its whole hash and length.  Partial aggregation keeps even a huge one cheap.
    whole = at.groupBy("conv").agg(F.max(F.struct("pos", "p1", "p2")).alias("w")).select("conv", F.col("w.pos").alias("n_turns"), F.col("w.p1").alias("p1"), F.col("w.p2").alias("p2"))
    one = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    # Proper prefixes, each once however many conversations share it.
    inner = at.join(whole.select("conv", "n_turns"), "conv").where("pos < n_turns").select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    maximal = one.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv", "n_turns", "n_copies")
    kept = at.join(maximal, "conv").select("conv", "turn", "h1", "h2", "pos", "start", "n_turns", "n_copies")
    texts = rows.groupBy("conv", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("rendered").alias("rendered"))
    same = F.expr("a.conv = b.conv and a.turn <=> b.turn and a.h1 = b.h1 and a.h2 = b.h2")
    return texts.alias("a").join(kept.alias("b"), same).select(F.col("a.conv").alias("conv_id"), "pos", "n_turns", "n_copies", "role", "start", "rendered")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT conv_id, role, coalesce(role, '') AS role_, coalesce(text, '') AS text_, role || chr(1) || text || chr(2) AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
  FROM t
), p AS (
  SELECT *, string_agg(seg, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, '<|im_start|>' || role_ || chr(10) || text_ || '<|im_end|>' || chr(10) AS rendered, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM r
), f AS (SELECT conv_id, prefix AS whole, n_turns FROM p WHERE pos = n_turns),
g AS (SELECT min(conv_id) AS conv_id, whole, n_turns, count(*) AS n_copies FROM f GROUP BY whole, n_turns),
m AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = g.n_turns AND p.prefix = g.whole))
SELECT p.conv_id, p.pos, p.n_turns, m.n_copies, p.role,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY p.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, p.rendered
FROM p JOIN m ON p.conv_id = m.conv_id
"""
