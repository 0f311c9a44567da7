"""Remediated files: lanes, states, triage and censuses; and searches over their extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.html import visible_text

# How failed rules are told apart, triage severities and useless alternative texts.
REEXPORT = r"(?i)not embedded|FontFile|7\.21\.4"
SEMANTIC = r"(?i)7\.3-|table|list|heading|7\.5|7\.4|alt"
MECHANICAL = r"(?i)7\.1-3|7\.21|7\.2-|6\.7|7\.18|metadata|ToUnicode|embed"
SEVERITY = {"scanned-image": 3, "text-untagged": 2, "encrypted": 2, "empty/odd": 1, "tagged": 0}
USELESS_ALT = (r"(?i)^(?:[\w\-. ]+\.(?:png|jpe?g|gif|bmp|tif{1,2}|emf|wmf|svg|webp|eps|pdf)|(?:picture|image|img|graphic|figure|diagram|chart|"
               r"object|shape|screenshot|screen ?shot|photo|clip ?art)\s*[-_ #]?\d*|dsc[_-]?\d+|img[_-]?\d+|untitled\s*\d*)$")
SURVIVAL = 0.98


def file_lane(status: Column, actions: Column, class_before: Column) -> Column:
    light = (status == "skipped") | F.array_join(F.coalesce(actions, F.array().cast("array<string>")), " ").contains("metadata-only")
    return (F.when(status.isNull(), "").when(status == "fallback", F.when(class_before.isin("encrypted", "signed", "empty/odd"), "refused").otherwise("queued"))
            .when(status == "review", "review").when(light, "light").when(status == "ok", "full").otherwise(""))


def rule_kind(rule: Column) -> Column:
    return (F.when(rule.rlike(REEXPORT), "source re-export").when(rule.rlike(SEMANTIC), "semantic").when(rule.rlike(MECHANICAL), "mechanical").otherwise("semantic"))


def item_state(row: dict[str, Column]) -> Column:
    """The state ladder of one file. Keys: legacy, fetched, report_only, scanned, unreadable, has_fixes,
    fixes_sha, verify_sha, verify_ok, push_sha."""
    b = lambda n: F.coalesce(row[n], F.lit(False))
    same = lambda n: F.coalesce(row[n] == row["fixes_sha"], F.lit(False))
    return (F.when(b("legacy"), "unsupported").when(~b("fetched"), "not fetched")
            .when(b("report_only"), F.when(b("scanned"), "triaged").otherwise("not scanned")).when(~b("scanned"), "not scanned")
            .when(b("unreadable"), "unsupported").when(same("push_sha") & b("has_fixes"), "pushed").when(~b("has_fixes"), "scanned")
            .when(same("verify_sha"), F.when(b("verify_ok"), "verified").otherwise("failed")).otherwise("fixes ready"))


def rule_census(results: DataFrame, examples: int = 5) -> DataFrame:
    """Files per failed rule (not occurrences), by lane, with the first few names."""
    rows = results.select("file_id", "name", "lane", F.explode(F.array_distinct("failed_rules")).alias("rule"))
    per_lane = rows.groupBy("rule", "lane").agg(F.count_distinct("file_id").alias("n"))
    lanes = per_lane.groupBy("rule").agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(F.struct("lane", "n"))).alias("lanes"))
    first = rows.withColumn("_p", F.row_number().over(W.partitionBy("rule").orderBy("name", "file_id"))).where(F.col("_p") <= examples)
    names = first.groupBy("rule").agg(F.array_sort(F.collect_list("name")).alias("examples"))
    return lanes.join(names, "rule").withColumn("kind", rule_kind(F.col("rule")))


def queue_groups(queue: DataFrame, keys: list[str]) -> DataFrame:
    """The review queue by the head of its reasons; one error makes the group an error."""
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("no reason recorded"))
    head = F.get(F.split(reason, r"\s+-\s+|:\s|\s\(", 2), F.lit(0))
    head = F.when(head == "", reason).otherwise(head)
    return queue.groupBy(*keys, head.alias("head")).agg(F.count(F.lit(1)).alias("count"), F.when(F.max(F.col("severity") == "error"), "error").otherwise("review").alias("severity"))


def file_triage(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Page facts to a class per file, worst first. ``files``: file_id, encrypted, tagged, and signed where that is known.

    A signed file is a class of its own, whatever is in it: a change would break the signature.
    """
    signed = F.coalesce("signed", F.lit(False)) if "signed" in files.columns else F.lit(False)
    per = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("has_text").alias("text_pages"), F.count_if("has_image").alias("image_pages"))
    j = files.join(per, "file_id", "left").na.fill(0, ["pages", "text_pages", "image_pages"])
    cls = (F.when(F.col("encrypted"), "encrypted").when(signed, "signed").when((F.col("pages") > 0) & (F.col("text_pages") < 0.5 * F.col("pages")) & (F.col("image_pages") > 0), "scanned-image")
           .when((F.col("text_pages") == 0) & (F.col("image_pages") == 0), "empty/odd").when(F.col("tagged"), "tagged").otherwise("text-untagged"))
    level = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return j.withColumn("class", cls).withColumn("severity", F.coalesce(level[F.col("class")], F.lit(1))).orderBy(F.desc("severity"), "file_id")


def alt_is_useless(alt: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(alt, F.lit(""))), r"^\.+|\.+$", "")
    return (t != "") & t.rlike(USELESS_ALT)


def image_reuse(figures: DataFrame, keys: list[str]) -> DataFrame:
    """Images by content: how many places and files one picture appears in."""
    return figures.groupBy(*keys, F.coalesce("hash", F.sha1(F.col("path"))).alias("hash")).agg(F.count(F.lit(1)).alias("places"), F.count_distinct("file_id").alias("files"))


def alt_census(figures: DataFrame, keys: list[str]) -> DataFrame:
    """Figures by what their description needs. ``described``: a text written since the scan."""
    todo = F.col("needs_alt")
    return figures.groupBy(*keys).agg(
        F.count_if(todo).alias("needs_alt"), F.count_distinct(F.when(todo, F.col("hash"))).alias("unique_pictures"), F.count_if(todo & F.col("described")).alias("described"),
        F.count_if(todo & F.col("path").isNull()).alias("no_picture"), F.count_if(alt_is_useless(F.col("alt"))).alias("useless_alt"),
        F.count_if(todo & ~F.col("described")).alias("waiting"))


def file_survey(files: DataFrame) -> DataFrame:
    """Courses by kinds: what is there, scanned, ready and uploaded. ``files``: course_id, kind, state, issues."""
    state = F.col("state")
    return files.groupBy("course_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~state.isin("not fetched", "not scanned")).alias("scanned"), F.sum("issues").alias("issues"),
        F.count_if(state == "unsupported").alias("needs_person"), F.count_if(state.isin("fixes ready", "verified")).alias("ready"), F.count_if(state == "pushed").alias("uploaded"))


def survey_totals(survey: DataFrame) -> DataFrame:
    return survey.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("files", "scanned", "issues", "needs_person", "ready", "uploaded")])


def hit_spans(texts: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """(keys, t, n, term, start, end) of every hit; offsets count characters from 0.

    The text is cut at its hits and the piece lengths add up, so every occurrence has its own place.
    """
    rows = texts.select(*keys, text.alias("t")).where(F.col("t").rlike(pattern))
    rows = rows.withColumn("hits", F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).withColumn("gaps", F.split("t", pattern, -1))
    rows = rows.select(*keys, "t", F.posexplode(F.arrays_zip("hits", F.slice("gaps", 1, F.size("hits")).alias("gap"))).alias("n", "z"))
    upto = W.partitionBy(*keys).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("z.hits") + F.length("z.gap")).over(upto).cast("int")
    return rows.select(*keys, "t", "n", F.col("z.hits").alias("term"), (end - F.length("z.hits")).alias("start"), end.alias("end"))


def kwic(texts: DataFrame, keys: list[str], text: str, pattern: str, around: int = 70) -> DataFrame:
    """Every hit of a pattern (no case) with the text around it; contexts may overlap."""
    rows = hit_spans(texts, keys, F.col(text), f"(?is){pattern}")
    lo = F.greatest(F.lit(0), F.col("start") - around)
    return rows.select(*keys, (F.col("n") + 1).alias("n"), "term",
                       F.regexp_replace(F.substr("t", lo + 1, F.col("end") + around - lo), r"\s+", " ").alias("context"))


def _escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def replace_map(texts: DataFrame, keys: list[str], text: str, mapping: dict[str, str]) -> DataFrame:
    """Literal replacements in turn, plain and escaped spelling, then a count of what is left (any case)."""
    out, left = F.col(text), F.lit(0)
    for find, to in mapping.items():
        for variant, put in {_escaped(find): _escaped(to), find: to}.items():
            out = F.replace(out, F.lit(variant), F.lit(put))
    rows = texts.select(*keys, out.alias("text"))
    for find in mapping:
        for variant in {find, _escaped(find)}:
            left = left + F.regexp_count("text", F.concat(F.lit(r"(?i)\Q"), F.lit(variant), F.lit(r"\E")))
    return rows.withColumn("residual", left)


def text_survival(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Share of the original's words that still occur in the revised text; pass at 98%."""
    # what is no letter, digit or blank goes in one pass, as do words that begin with a slash; both versions meet in one shuffle of texts
    bare = F.regexp_replace("text", r"(?U)(?<!\S)/\S*|[^\p{L}\p{N}\s]+", "")
    sides = old.select(key, "text", F.lit(True).alias("_old")).union(new.select(key, "text", F.lit(False))).repartition(key)
    each = sides.select(key, "_old", F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "").alias("w"))
    each = each.select(key, F.col("_old").cast("int").alias("_n"), F.explode(F.when(F.col("_old"), F.col("w")).otherwise(F.array_distinct("w"))).alias("w"))
    j = each.groupBy(key, "w").agg(F.sum("_n").alias("n"), F.min("_n").alias("_side")).where("n > 0")
    gone = (F.col("_side") == 1) | F.col(key).isNull()  # a null key meets nothing
    per = j.groupBy(key).agg(F.sum("n").alias("words"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("missing"))
    share = 1.0 - F.col("missing") / F.col("words")
    return per.select(key, "words", "missing", F.round(share, 4).alias("share"), (share >= SURVIVAL).alias("ok"))


def word_diff(old: DataFrame, new: DataFrame, key: str, html: str = "html", top: int = 30) -> DataFrame:
    """Words lost and gained between two versions as multisets; totals over all, the top thirty listed."""
    toks = F.regexp_extract_all(F.lower(visible_text(F.col(html))), F.lit("[a-z0-9]+"), F.lit(0))
    sides = old.select(key, html, F.lit(1).alias("_old")).union(new.select(key, html, F.lit(0))).where(F.col(key).isNotNull()).repartition(key)
    each = sides.select(key, "_old", F.explode(toks).alias("word"))
    j = each.groupBy(key, "word").agg(F.sum("_old").alias("a"), F.sum(1 - F.col("_old")).alias("b")).where("a <> b")
    side = F.when(F.col("a") > F.col("b"), "lost").otherwise("gained")
    rows = j.select(key, side.alias("side"), "word", F.abs(F.col("a") - F.col("b")).alias("count"))
    order = W.partitionBy(key, "side").orderBy(F.desc("count"), "word")
    total = F.sum("count").over(W.partitionBy(key, "side"))
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("total", total)
    return ranked.where(F.col("place") <= top)
