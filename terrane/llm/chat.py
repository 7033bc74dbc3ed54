"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant, the others as named users, and
system turns as they are; the loss mask covers what the assistant says and its end mark. The result is a row for each turn and
perspective with its place in the rendered text, so that no task holds a whole dialogue: places are running sums within stretches
of turns plus the sums of the stretches before. The sums are made of sizes alone; texts are dealt out once, and meet the places of all their
perspectives there. ``assemble`` joins dialogues to single texts where they are short enough to be training documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are summed in one window.
STRETCH = 512


def _plain(col: Column) -> Column:
    """Text that can't end its own turn or start another."""
    return F.replace(col, F.lit("<|im_"), F.lit("< |im_"))


def rotate(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, label, segment, trained, start, end, mask_start, mask_end: one row per turn and participant of its dialogue.

    segment: ``<|im_start|>label``, line break, text, ``<|im_end|>``, line break. [start, end): its characters in the rendered
    text; trained: the loss covers its text and end mark, the characters [mask_start, mask_end), else null. Participants are the distinct
    speakers but ``system``; a dialogue of system turns only has none, and so no rows. A null speaker is a participant of its own, to
    others a ``user`` without a name; a null text is empty; rows with a null id are one dialogue; null turns come first. Turns with equal
    numbers are ordered by speaker (null first) and the MD5 of the text; equal rows are one after another. Marks within texts and names are
    broken up and line breaks in names are spaces, so that neither can forge a turn. An empty table gives no rows."""
    role = F.col(role_col).cast("string")
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.concat(F.lit("="), role), F.lit("")).alias("who"),
        _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    ).withColumn("text_key", F.md5(F.col("body").cast("binary")))
    rows = rows.withColumn("at", F.coalesce(F.col("turn"), F.lit(-(2**63))))
    one = ["conv", "at", "who", "text_key"]
    said = rows.groupBy(*one).agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("body").alias("body"), F.count("*").alias("copies"))

    other = F.when(F.col("who") == "=" + system, F.lit(system)).when(F.col("who") == "", F.lit("user"))
    other = other.otherwise(F.concat(F.lit("user name="), F.translate(_plain(F.expr("substring(who, 2)")), "\r\n", "  ")))
    sizes = rows.groupBy(*one).agg(F.count("*").alias("copies"), F.first(F.char_length("body")).alias("size"))
    people = rows.filter(F.col("who") != "=" + system).select("conv", F.col("who").alias("perspective")).distinct()
    seen = sizes.join(people, "conv").withColumn("trained", F.col("who") == F.col("perspective"))
    seen = seen.withColumn("label", F.when(F.col("trained"), F.lit("assistant")).otherwise(other))
    seen = seen.withColumn("size", (F.col("size") + F.char_length("label") + len(START) + len(END) + 2).cast("long")).withColumn("stretch", F.floor(F.col("at") / STRETCH))
    key = ["conv", "perspective"]
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = seen.groupBy(*key, "stretch").agg(F.sum(F.col("size") * F.col("copies")).alias("all")).select(*key, "stretch", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*key, "stretch").orderBy("at", "who", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("inside", F.sum(F.col("size") * F.col("copies")).over(inside)).join(sums, [*key, "stretch"])
    first = F.col("ahead") + F.col("inside") - F.col("size") * F.col("copies")
    placed = placed.select(*one, "perspective", "trained", "label", "size", first.alias("first"))

    out = said.join(placed, one).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: F.col("first") + k * F.col("size"))))
    out = out.withColumn("end", F.col("start") + F.col("size"))
    return out.select(
        "conv_id",
        F.when(F.col("perspective") != "", F.expr("substring(perspective, 2)")).alias("perspective"),
        "turn",
        "label",
        F.concat(F.lit(START), F.col("label"), F.lit("\n"), F.col("body"), F.lit(END + "\n")).alias("segment"),
        "trained",
        "start",
        "end",
        F.when(F.col("trained"), F.col("start") + len(START) + F.char_length("label") + 1).alias("mask_start"),
        F.when(F.col("trained"), F.col("end") - 1).alias("mask_end"),
    )


def assemble(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text, spans: whole rendered dialogues and the character ranges that the loss covers. For dialogues
    that fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    spans = F.transform(F.filter("turns", lambda t: t.mask_start.isNotNull()), lambda t: F.struct(t.mask_start.alias("start"), t.mask_end.alias("end")))
    return rotated.groupBy("conv_id", "perspective").agg(turns.alias("turns")).select("conv_id", "perspective", F.array_join(F.transform("turns", lambda t: t.segment), "").alias("text"), spans.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "perspective", "turn", "label", "trained", "start", "end", "mask_start", "mask_end", F.md5(F.col("segment").cast("binary")).alias("segment_md5"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'
), s AS (
  SELECT t.*, p.perspective, speaker IS NOT DISTINCT FROM perspective AS trained,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' WHEN speaker IS NULL THEN 'user'
      ELSE 'user name=' || translate(replace(speaker, '<|im_', '< |im_'), chr(13) || chr(10), '  ') END AS label
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (
  SELECT *, '<|im_start|>' || label || chr(10) || body || '<|im_end|>' || chr(10) AS segment FROM s
), e AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, md5(body) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g
)
SELECT conv_id, perspective, turn, label, trained, "end" - length(segment) AS start, "end",
  CASE WHEN trained THEN "end" - length(segment) + 13 + length(label) END AS mask_start, CASE WHEN trained THEN "end" - 1 END AS mask_end, md5(segment) AS segment_md5
FROM e
"""
