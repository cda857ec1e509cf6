"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once, with that participant as the assistant, all
others as named users and system turns as they are. The result has a row for each turn of each rendering, so no dialogue
is ever put together in one task: ``segment`` is the turn's text in the template, ``start`` its place (in code points) in
the rendering, which is the segments joined in the order of ``seq``; the training mask is the span [mask_start, mask_end)
of the rendering, null where nothing of the turn is trained on. Places come from sums inside blocks of ``BLOCK`` turn
numbers, and then sums of whole blocks, so one very long dialogue is shared out over tasks.

Defined results: a null conv_id belongs to no dialogue and is dropped; a null or blank role is the speaker 'unknown'; a
null text is empty; a null turn comes first; turns with equal numbers are ordered by speaker, then text; repeated rows
are turns of their own; a dialogue of system turns alone has no participant and no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import own_columns, table

BLOCK = 256
SYSTEM = "system"
OPEN, NAME, BODY, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    own = own_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    turns = own.select(
        "conv_id",
        "turn",
        F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("block"),
    )
    parties = turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when((F.col("speaker") != F.col("perspective")) & (F.col("speaker") != SYSTEM), F.col("speaker"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.coalesce(F.concat(F.lit(NAME), F.col("name")), F.lit("")), F.lit(BODY))
    rendered = (
        turns.join(parties, "conv_id")
        .withColumns({"role": role, "name": name})
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", "content", F.lit(CLOSE)))
        .withColumn("size", F.length("segment").cast("long"))
    )
    in_block = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "content").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rendered.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("n_chars"), F.count("*").alias("n_turns"))
    blocks = blocks.select("conv_id", "perspective", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n_chars", "n_turns")])
    placed = rendered.select(
        "*",
        F.row_number().over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("place"),
        (F.sum("size").over(in_block) - F.col("size")).alias("chars"),
    )
    trained = F.col("role") == "assistant"
    start = F.col("chars") + F.col("n_chars_before")
    return placed.join(blocks, ["conv_id", "perspective", "block"]).select(
        "conv_id",
        "perspective",
        (F.col("place") + F.col("n_turns_before")).cast("long").alias("seq"),
        "turn",
        "role",
        "name",
        "segment",
        start.cast("long").alias("start"),
        F.when(trained, start + F.length("head")).cast("long").alias("mask_start"),
        F.when(trained, start + F.col("size")).cast("long").alias("mask_end"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') AS speaker, coalesce("text", '') AS content
  FROM conversations WHERE conv_id IS NOT NULL),
parties AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
named AS (
  SELECT t.*, p.perspective,
    CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS "role",
    CASE WHEN t.speaker <> p.perspective AND t.speaker <> 'system' THEN t.speaker END AS "name"
  FROM turns t JOIN parties p USING (conv_id)),
headed AS (SELECT *, '<|im_start|>' || "role" || coalesce(' name=' || "name", '') || chr(10) AS head FROM named),
rendered AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER w AS seq, sum(length(segment)) OVER w - length(segment) AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, "role", "name", segment, CAST(start AS BIGINT) AS start,
  CASE WHEN "role" = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN "role" = 'assistant' THEN CAST(start + length(segment) AS BIGINT) END AS mask_end
FROM placed
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))
