"""Passages and student voice out of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.text import squash
from gradeloom.operators.files import hit_spans

# The reach of a passage and how far apart passages may lie and still be one.
REACH, JOIN_GAP = 700, 40
# Cues of a student's own experience as (category, pattern, needs a first person).
# The first cue that fits names the sentence.
CUES = (
    ("technical", r"\b(?:version|update|install\w*|crashed?|crashing|freez\w+|would ?n[o']t (?:open|load|run|export|save)|corrupt\w*)\b"
                  r"[^.?!]{0,80}\b(?:different|older|newer|mine|my|problem|issue|error)\b", False),
    ("technical", r"\b(?:i|my)\b[^.?!]{0,60}\b(?:version|laptop|computer|software|blender|unity|program)\b[^.?!]{0,60}"
                  r"\b(?:different|older|newer|crash\w*|would ?n[o']t|could ?n[o']t|does ?n[o']t)\b", False),
    ("instructions", r"\b(?:instructions?|directions?|prompt|assignment|rubric|handout|guidelines?)\b[^.?!]{0,60}\b(?:unclear|confusing|vague|"
                     r"did ?n[o']t say|didnt say|does ?n[o']t say|never said|contradict\w*|ambiguous|hard to (?:follow|read|understand))\b", False),
    ("instructions", r"\b(?:i|we)\s+(?:read|reread|re-read)\s+the\s+(?:instructions?|prompt|rubric|directions?)\b", False),
    ("instructions", r"(?:\bnot|n[o']t)\s+sure\s+(?:if|whether)\s+(?:this|that|i)\s+(?:is|was|did)\s+what\s+(?:you|the assignment|the prompt)\b", False),
    ("missed_resource", r"\b(?:i|we)\s+(?:could ?n[o']t|did ?n[o']t)\s+find\s+the\s+(?:video|reading|tutorial|slides?|link|file|example|rubric)\b", False),
    ("missed_resource", r"\b(?:the|that)\s+(?:video|tutorial|reading|lecture|slides?)\b[^.?!]{0,60}\b(?:did ?n[o']t (?:cover|show|explain)|"
                        r"never (?:covered|showed)|broken|missing|would ?n[o']t (?:play|load))\b", False),
    ("time", r"\b(?:i|we)\s+(?:ran out of time|did ?n[o']t have (?:enough )?time|was rushed|ran short on time)\b", False),
    ("time", r"\bif\s+i\s+had\s+(?:more|had)\s+time\b", False),
    ("confusion", r"(?:\bdid ?n[o']t|\bdidnt|\bdont|\bdo ?n[o']t|n[o']t|\bcouldn?[o']?t|\bcannot|\bcan ?n[o']t)\s+(?:really\s+)?"
                  r"(?:understand|get|follow|figure out|see how|know how)\b", True),
    ("confusion", r"\b(?:i|we)\s+(?:was|were|am|got|kept|felt)\s+(?:really\s+|very\s+|kind of\s+|a bit\s+|so\s+)?"
                  r"(?:confused|lost|stuck|unsure|uncertain|overwhelmed)\b", False),
    ("confusion", r"(?:\bnot|n[o']t)\s+(?:really\s+)?sure\s+(?:what|how|why|if|whether|where)\b", True),
    ("confusion", r"\b(?:confusing|unclear|ambiguous|vague)\b", True),
)
FIRST_PERSON = r"(?i)\b(?:i|i'?m|i'?ve|my|we|our|us|me)\b"
ASKING = (r"(?i)\b(?:should|shall|do|does|did|can|could|would|is|are|was|were|will|may)\s+(?:i|we|my|our)\b|"
          r"\b(?:i|we)\s+(?:was|were|am)\s+wondering\b")
SENTENCE = r"[^.!?\n]+[.!?]?"
ALWAYS_KEPT, LISTED = 2, 4


def policy_passages(texts: DataFrame, keys: list[str], text: str, pattern: str, reach: int = REACH) -> DataFrame:
    """Passages around keyword hits, snapped to sentence ends, overlapping ones merged; all of them, whole, in order."""
    rows = hit_spans(texts, keys, squash(F.col(text)), f"(?i){pattern}")
    lo, hi = F.greatest(F.lit(0), F.col("start") - reach), F.least(F.length("t"), F.col("end") + reach)
    rows = rows.withColumns({"lo": lo, "hi": hi})
    head = F.substr("t", F.col("lo") + 1, F.col("start") - F.col("lo"))
    tail = F.substr("t", F.col("end") + 1, F.col("hi") - F.col("end"))
    back = F.when((F.col("lo") > 0) & head.contains(". "), F.length(F.regexp_extract(head, r"(?s)^(.*\. )", 1))).otherwise(0)
    ahead = F.locate(". ", tail)
    stop = F.when((F.col("hi") < F.length("t")) & (ahead > 0), F.col("end") + ahead).otherwise(F.col("hi"))
    spans = rows.select(*keys, "t", (F.col("lo") + back).alias("a"), stop.alias("b"))
    order = W.partitionBy(*keys).orderBy("a", "b")
    seen = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("first", F.coalesce(F.col("a") > seen + JOIN_GAP, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = spans.groupBy(*keys, "island").agg(F.first("t").alias("t"), F.min("a").alias("a"), F.max("b").alias("b"))
    cut = F.trim(F.substr("t", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")))
    parts = joined.select(*keys, F.struct("island", cut.alias("p")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select(*keys, F.size("xs").alias("passages"), F.array_join(F.transform("xs", lambda x: x["p"]), "\n\n").alias("text"))


def voice_category(sentence: Column) -> Column:
    """Category of a sentence in which a student speaks of their own experience, else null."""
    person = sentence.rlike(FIRST_PERSON)
    out = F.when(F.length(sentence).between(12, 400) == F.lit(False), F.lit(None).cast("string"))
    for category, pattern, needs_person in CUES:
        hit = sentence.rlike(f"(?i){pattern}")
        out = out.when(hit & person if needs_person else hit, category)
    return out.when(sentence.rlike(r"\?\s*$") & (sentence.rlike(ASKING) | person), "question")


def voice_items(texts: DataFrame, keys: list[str], text: str, source: str) -> DataFrame:
    """One row per speaking sentence and text, repeats of a sentence left out."""
    rows = texts.select(*keys, source, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("pos", "s"))
    rows = rows.withColumn("s", F.trim("s")).withColumn("category", voice_category(F.col("s"))).where("category IS NOT NULL")
    return rows.groupBy(*keys, source, F.lower("s").alias("_k")).agg(F.min_by(F.struct("category", "s"), "pos").alias("x"), F.min("pos").alias("pos")).select(
        *keys, source, "pos", "x.category", F.col("x.s").alias("sentence"))


def student_voice(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One voice per student: the first two sentences, then only new categories; four are listed.

    Returns the kept items with ``place``; count them per category for the class view.
    """
    said = W.partitionBy(*keys).orderBy(*order)
    kind = W.partitionBy(*keys, "category").orderBy(*order)
    kept = items.withColumns({"_n": F.row_number().over(said), "_k": F.row_number().over(kind)}).where((F.col("_n") <= ALWAYS_KEPT) | (F.col("_k") == 1))
    return kept.withColumn("place", F.row_number().over(said)).withColumn("listed", F.col("place") <= LISTED).drop("_n", "_k")
