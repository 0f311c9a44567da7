"""Academic calendar sources: term tables, break pages and programme catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.dates import break_days, term_name
from gradeloom.functions.html import ANY_TAG, unescape

# What a row of the calendar page is, and what it is not.
NOT_A_BREAK = (r"(?i)classes begin|courses begin|courses start|classes start|registration|advising|exam|grades due|midterm|"
               r"residence|convocation|workshop|orientation")
PAGE_DATE = (r"(?i)(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+(January|February|March|April|May|June|July|August|"
             r"September|October|November|December)\s+(\d{1,2})(?:\s*-\s*\d{1,2})?,?\s+(\d{4})")
PAGE_TERM = r"(?i)^(Fall|Spring|Summer)\s+(\d{4})\s+Academic Schedule\s*$"


def term_table(raw: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Term rows from a JSON table keyed by term."""
    shape = "map<string,struct<finalsEnd:string,finals_end:string,breaks:array<string>>>"
    rows = raw.select(*keys, F.explode(F.from_json(json, shape)).alias("term", "e"))
    return rows.select(*keys, "term", F.try_to_date(F.coalesce("e.finalsEnd", "e.finals_end")).alias("finals_end"),
                       break_days(F.coalesce("e.breaks", F.array().cast("array<string>"))).alias("break_days"))


def lookup_term(dated: DataFrame, start: str, terms: DataFrame) -> DataFrame:
    """The term each start date falls in; terms are a handful of rows per school."""
    return dated.withColumn("term", term_name(F.col(start))).join(terms, "term", "left")


def break_days_from_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """No-class days from calendar pages: single holidays, and BEGIN/END rows paired into ranges.

    A begin without an end, or an end without a begin, is its own day.
    """
    section = r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>((?:(?!<h[23]\b).)*)"
    text = lambda c: F.trim(F.regexp_replace(unescape(F.regexp_replace(c, ANY_TAG, "")), r"(?U)\s+", " "))
    secs = pages.select(key, F.explode(F.arrays_zip(
        F.regexp_extract_all(html, F.lit(section), F.lit(1)).alias("head"),
        F.regexp_extract_all(html, F.lit(section), F.lit(2)).alias("body"))).alias("s"))
    secs = secs.select(key, F.concat_ws(" ", F.initcap(F.regexp_extract(text(F.col("s.head")), PAGE_TERM, 1)),
                                        F.regexp_extract(text(F.col("s.head")), PAGE_TERM, 2)).alias("term"), F.col("s.body").alias("body"))
    rows = secs.where("term <> ' '").select(key, "term", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr"))
    cells = rows.select(key, "term", "pos", F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)).alias("td")).where(F.size("td") >= 2)
    cells = cells.select(key, "term", "pos", text(F.col("td")[0]).alias("at"), F.get(F.split(text(F.col("td")[1]), "[;(]"), F.lit(0)).alias("what"))
    what = F.col("what")
    kind = (F.when(what.rlike(NOT_A_BREAK), F.lit(None)).when(what.rlike(r"(?i)\bholiday\b") & ~F.lower(what).contains("break"), "day")
            .when(what.rlike(r"(?i)\b(?:break|holidays)\b"), F.when(what.rlike(r"(?i)\bbegins?\b"), "begin").when(what.rlike(r"(?i)\bends?\b"), "end")))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(what, r"(?i)\b(?:begins?|ends?|holidays?)\b", " "), r"\s+", " "), r"^[ ,-]+|[ ,-]+$", "")
    name = F.when(F.lower(name).isin("spring", "fall", "summer", "winter"), F.concat(name, F.lit(" break"))).when(name == "", "Campus break").otherwise(name)
    day = F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.left(F.regexp_extract("at", PAGE_DATE, 1), F.lit(3))), F.regexp_extract("at", PAGE_DATE, 2),
                                         F.regexp_extract("at", PAGE_DATE, 3)), F.lit("MMM d yyyy")).cast("date")
    ev = cells.select(key, "term", "pos", kind.alias("kind"), name.alias("name"), day.alias("day")).where("kind IS NOT NULL AND day IS NOT NULL")
    # First by name, the n-th begin with the n-th end; then an end left over closes the begin left just before it.
    nth = W.partitionBy(key, "term", F.lower("name"), "kind").orderBy("pos")
    named = W.partitionBy(key, "term", "low", "nth")
    ev = ev.withColumns({"low": F.lower("name"), "nth": F.row_number().over(nth)})
    ends = ev.where("kind <> 'day'").withColumn("paired", F.count(F.lit(1)).over(named) > 1)
    by_pos = W.partitionBy(key, "term", "paired").orderBy("pos")
    closes = (F.col("kind") == "end") & (F.lag("kind").over(by_pos) == "begin")
    slot = F.when(F.col("paired"), F.concat_ws("#", "low", "nth")).when(closes, F.lag("pos").over(by_pos).cast("string")).otherwise(F.col("pos").cast("string"))
    spans = ends.withColumn("slot", slot).groupBy(key, "term", "paired", "slot").agg(
        F.min_by("name", "pos").alias("name"), F.min("day").alias("a"), F.max("day").alias("b"))
    single = ev.where("kind = 'day'").select(key, "term", "name", F.col("day").alias("a"), F.col("day").alias("b"))
    days = spans.select(single.columns).unionByName(single).select(key, "term", "name", F.explode(F.sequence("a", "b")).alias("day"))
    return days.groupBy(key, "term", "day").agg(F.max("name").alias("name"))


def program_index(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Catalogue cards to programme rows; cards still to be named drop out."""
    card = r'(?s)<a class="curriculum-card" href="([^"]+)">(.*?)</a>'
    cards = pages.select(key, F.explode(F.arrays_zip(
        F.regexp_extract_all(html, F.lit(card), F.lit(1)).alias("slug"), F.regexp_extract_all(html, F.lit(card), F.lit(2)).alias("body"))).alias("c"))
    span = lambda cls: F.trim(unescape(F.regexp_replace(F.regexp_extract(
        F.col("c.body"), rf'(?s)<span class="{cls}">(?:<strong>[^<]*</strong>)?(.*?)</span>', 1), ANY_TAG, "")))
    rows = cards.select(key, span("cip-card-title").alias("name"), span("cip-card-name").alias("cip_class"), span("cip-card-code").alias("cip"),
                        F.filter(F.transform(F.split(span("cip-card-prefix"), ","), lambda p: F.upper(F.trim(p))), lambda p: p != "").alias("prefixes"),
                        F.col("c.slug").alias("slug"))
    return rows.where((F.col("name") != "") & (F.upper("name") != "TBD"))


def program_resolve(courses: DataFrame, programs: DataFrame) -> DataFrame:
    """Course prefix to candidate programmes: unique, ambiguous or none."""
    prefix = F.upper(F.regexp_extract("course_code", r"^\s*([A-Za-z]{2,4})", 1))
    by_prefix = programs.select(F.explode(F.array_distinct("prefixes")).alias("prefix"), "name", "slug").groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    rows = courses.select("course_id", "course_code", prefix.alias("prefix")).join(by_prefix, "prefix", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("course_id", "course_code", "prefix", n.alias("candidates"),
                       F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("none").alias("verdict"),
                       F.when(n == 1, F.col("first")).alias("program"))
