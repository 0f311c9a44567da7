"""Chat formatting by multi-party perspective rotation. DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once more, with that speaker as the assistant and all others as
named users; only the assistant's words (and the mark that ends them) are under the loss mask. ``system`` turns are instructions: they
are rendered as such for everyone and give no perspective of their own.

The result is one row per perspective and turn: the rendered segment, its character range in the rendering and the masked range
inside it. A segment list needs no group in one task: places come from two running sums, one inside ``STEP`` consecutive turns and one over the
steps' totals, so one dialogue may hold a third of all rows. ``part`` cuts a long rendering into examples of about ``PART_CHARS``
characters at turn borders (``part_start`` counts from the part's first character); ``assembled`` joins the segments of each part to its text and mask
list, groups of bounded size but for a single longer turn.

Marks that occur in a text, and control characters, line breaks and marks in a name, are defused, so a turn cannot forge another.

Null role: a speaker named ``unknown``. Null or empty text: an empty turn, still rendered. Null turn: after all numbered ones. Null conv_id: one
dialogue of its own. Ties of turn go by role, then text; equal rows follow one another. A dialogue of system turns only has no
perspective and no rows. Extra columns are dropped. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
STEP, PART_CHARS = 64, 32_000


def _defused(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _speaker(role: Column) -> Column:
    name = F.regexp_replace(_defused(F.coalesce(role, F.lit("unknown"))), r"[\p{Cc}\p{Zl}\p{Zp}=]+", " ")
    return F.when(F.trim(name) == "", F.lit("unknown")).otherwise(name)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (place of the turn in its dialogue, from 0), speaker, body."""
    rows = conversations.select("conv_id", "turn", _speaker(F.col("role")).alias("speaker"), _defused(F.coalesce("text", F.lit(""))).alias("body"))
    # places without a window over a whole dialogue: equal turn numbers are ranked together, and each number starts after those before it
    coarse = F.coalesce(F.floor(F.col("turn") / STEP), F.lit(1 << 50)).cast("long")
    rows = stage(rows.withColumn("step", coarse))
    sizes = rows.groupBy("conv_id", "step").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "step").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    placed = rows.withColumn("nth", F.row_number().over(within) - 1)
    return (placed.join(bases, placed["conv_id"].eqNullSafe(bases["c"]) & (F.col("step") == F.col("s")))
            .select("conv_id", (F.col("base") + F.col("nth")).alias("seq"), "turn", "speaker", "body"))


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, assistant, seq, turn, role, segment, start, end, mask_start, mask_end, part, part_start.

    ``start``/``end`` are places in the whole rendering (end exclusive); the mask is null on turns of others.
    """
    told = stage(turns(conversations))
    who = (told.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("assistant")).distinct())
    own = F.col("speaker") == F.col("assistant")
    head = (F.when(F.col("speaker") == "system", F.lit(f"{OPEN}system\n")).when(own, F.lit(f"{OPEN}assistant\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("speaker"), F.lit("\n"))))
    every = (told.join(who, told["conv_id"].eqNullSafe(who["c"])).drop("c")
             .withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit(f"{CLOSE}\n")))
             .withColumn("size", F.length("segment").cast("long")).withColumn("step", F.floor(F.col("seq") / STEP)))
    sums = every.groupBy("conv_id", "assistant", "step").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id", "assistant").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c"), F.col("assistant").alias("a"), F.col("step").alias("s"),
                        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("conv_id", "assistant", "step").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = (placed.join(bases, placed["conv_id"].eqNullSafe(bases["c"]) & (F.col("assistant") == F.col("a")) & (F.col("step") == F.col("s")))
              .withColumn("start", F.col("base") + F.col("inner")).withColumn("part", F.floor(F.col("start") / PART_CHARS)))
    mask_start = F.when(own, F.col("start") + F.length("head"))
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    firsts = placed.groupBy("conv_id", "assistant", "part").agg(F.min("start").alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("fc"), F.col("assistant").alias("fa"), F.col("part").alias("fp"), "first")
    return (placed.join(firsts, placed["conv_id"].eqNullSafe(firsts["fc"]) & (F.col("assistant") == F.col("fa")) & (F.col("part") == F.col("fp")))
            .select("conv_id", "assistant", "seq", "turn", role.alias("role"), "segment", "start", (F.col("start") + F.col("size")).alias("end"),
                    mask_start.alias("mask_start"), F.when(own, F.col("start") + F.col("size") - 1).alias("mask_end"), "part",
                    (F.col("start") - F.col("first")).alias("part_start")))


def assembled(rotated: DataFrame) -> DataFrame:
    """conv_id, assistant, part, text, masks: the examples, masks as character ranges of the example's text."""
    item = F.struct("seq", "segment", "mask_start", "mask_end", (F.col("start") - F.col("part_start")).alias("shift"))
    grouped = rotated.groupBy("conv_id", "assistant", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    masks = F.transform(F.filter("items", lambda i: i["mask_start"].isNotNull()),
                        lambda i: F.struct((i["mask_start"] - i["shift"]).alias("start"), (i["mask_end"] - i["shift"]).alias("end")))
    return grouped.select("conv_id", "assistant", "part", F.array_join(F.transform("items", lambda i: i["segment"]), "").alias("text"), masks.alias("masks"))


def op7_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    return (perspectives(documents(spark, sf_dir, "conversations"))
            .select("conv_id", "assistant", "seq", "role", "start", "end", "mask_start", "mask_end", "part", "part_start",
                    F.md5(F.col("segment").cast("binary")).alias("segment_md5")))


SQL = rf"""
WITH r AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS n,
    replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS body FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN trim(n) = '' THEN 'unknown' ELSE regexp_replace(n, '[\p{{Cc}}\p{{Zl}}\p{{Zp}}=]+', ' ', 'g') END AS speaker, body FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS seq FROM t),
w AS (SELECT DISTINCT conv_id, speaker AS assistant FROM s WHERE speaker <> 'system'),
e AS (SELECT s.conv_id, assistant, seq, speaker, CASE WHEN speaker = 'system' THEN '{OPEN}system' || chr(10) WHEN speaker = assistant
        THEN '{OPEN}assistant' || chr(10) ELSE '{OPEN}user name=' || speaker || chr(10) END AS head, body
      FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
g AS (SELECT *, head || body || '{CLOSE}' || chr(10) AS segment FROM e),
p AS (SELECT *, length(segment) AS size, (sum(length(segment)) OVER (PARTITION BY conv_id, assistant ORDER BY seq) - length(segment))::BIGINT AS start FROM g)
SELECT conv_id, assistant, seq, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = assistant THEN 'assistant' ELSE 'user' END AS role,
  start, start + size AS "end", CASE WHEN speaker = assistant THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = assistant THEN start + size - 1 END AS mask_end, start // {PART_CHARS} AS part,
  start - min(start) OVER (PARTITION BY conv_id, assistant, start // {PART_CHARS}) AS part_start, md5(segment) AS segment_md5
FROM p
"""
