"""Accessibility scores per file and course, before and after remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a defect costs, and how often one defect counts per file.
WEIGHTS = {
    "pdf_scanned": 85, "pdf_untagged": 45, "pdf_no_ua": 20, "pdf_figure_no_alt": 8, "pdf_no_title": 5,
    "html_img_no_alt": 12, "html_alt_filename": 8, "html_no_heading": 15, "html_skipped_heading": 8,
    "html_table_no_header": 10, "html_empty_link": 6, "html_script": 6,
    "office_no_alt": 12, "office_no_title": 8, "office_table_no_header": 10}
REPEAT_CAP = 3
# Which finding of the page scan is which defect; the first that fits counts.
ISSUE_DEFECTS = (("img missing alt", "html_img_no_alt"), ("alt is a filename", "html_alt_filename"),
                 ("no semantic heading", "html_no_heading"), ("skipped heading level", "html_skipped_heading"),
                 ("table without", "html_table_no_header"), ("empty link", "html_empty_link"),
                 ("script element", "html_script"), ("inline event handler", "html_script"), ("javascript: link", "html_script"))
WORST = 8


def score_counts(counts: dict[str, Column]) -> Column:
    """100 minus the capped cost of counted defects, within 0..100."""
    cost = F.lit(0)
    for name, n in counts.items():
        cost = cost + F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(REPEAT_CAP)) * WEIGHTS.get(name, 0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - cost)), 1)


def a11y_score(defects: DataFrame, keys: list[str], defect: str = "defect") -> DataFrame:
    """Score per file from one row per defect."""
    n = defects.groupBy(*keys).agg(*[F.count_if(F.col(defect) == d).alias(d) for d in WEIGHTS])
    return n.select(*keys, score_counts({d: F.col(d) for d in WEIGHTS}).alias("score"))


def html_defects(issues: Column) -> Column:
    def one(issue):
        out = F.lit(None).cast("string")
        for needle, name in reversed(ISSUE_DEFECTS):
            out = F.when(issue.contains(needle), name).otherwise(out)
        return out
    return F.array_compact(F.transform(issues, one))


def _counts(defects: Column, names) -> dict[str, Column]:
    return {n: F.size(F.filter(defects, lambda d: d == n)) for n in names}


def html_before_after(bodies: DataFrame, keys: list[str], issues: str, done: Column) -> DataFrame:
    """A restyle fixes structure; pictures without a description stay without one."""
    names = sorted({d for _, d in ISSUE_DEFECTS})
    scanned = bodies.where(F.col(issues).isNotNull()).withColumn("_d", html_defects(F.col(issues)))
    before = score_counts(_counts(F.col("_d"), names))
    after = score_counts(_counts(F.col("_d"), ("html_img_no_alt", "html_alt_filename")))
    return scanned.select(*keys, F.lit("Pages").alias("part"), before.alias("before"),
                          F.when(done, after).otherwise(before).alias("after"), done.alias("fixed"))


def office_before_after(files: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``files``: alt_todo, alt_done, untitled, titled, headerless, headers_fixed, fixed; scanned files only."""
    c = F.col
    before = score_counts({"office_no_alt": c("alt_todo") + c("alt_done"), "office_no_title": c("untitled"),
                           "office_table_no_header": c("headerless")})
    after = score_counts({"office_no_alt": c("alt_todo"), "office_no_title": c("untitled") - c("titled"),
                          "office_table_no_header": F.when(c("headers_fixed"), 0).otherwise(c("headerless"))})
    return files.select(*keys, F.lit(part).alias("part"), before.alias("before"),
                        F.when(c("fixed"), after).otherwise(before).alias("after"), "fixed")


def pdf_before_after(files: DataFrame, keys: list[str]) -> DataFrame:
    """``files``: class_before, figures_waiting, compliant, fixed. A conformance verdict counts only
    where the original was scanned or untagged, for then it failed too."""
    was, wait = F.coalesce("class_before", F.lit("")), F.col("figures_waiting")
    scan, untagged = was.contains("scan"), was.contains("untagged")
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    before = score_counts({"pdf_scanned": flag(scan), "pdf_untagged": flag(~scan & untagged),
                           "pdf_no_ua": flag(scan | untagged), "pdf_figure_no_alt": wait})
    after = score_counts({"pdf_no_ua": flag((scan | untagged) & (F.col("compliant") == F.lit(False))),
                          "pdf_figure_no_alt": wait})
    return files.select(*keys, F.lit("PDFs").alias("part"), before.alias("before"),
                        F.when(F.col("fixed"), after).otherwise(before).alias("after"), "fixed")


def forecast_parts(scored: DataFrame, listed: DataFrame, course: str) -> DataFrame:
    """State of each kind of file per course: scored, waiting, empty or never listed.

    ``listed``: course, part, listed (count; null where nothing was ever listed), one row per kind.
    """
    per = scored.groupBy(course, "part").agg(F.count(F.lit(1)).alias("checked"))
    rows = listed.join(per, [course, "part"], "left").withColumn("checked", F.coalesce("checked", F.lit(0)))
    state = (F.when(F.col("checked") > 0, "scored").when(F.col("listed").isNull(), "unlisted")
             .when(F.col("listed") == 0, "empty").otherwise("waiting"))
    return rows.select(course, "part", "checked", "listed", state.alias("state"))


def a11y_forecast(scored: DataFrame, course: str) -> DataFrame:
    means = scored.groupBy(course).agg(F.count(F.lit(1)).alias("files"), F.count_if("fixed").alias("fixed"),
                                       F.avg("before").alias("b"), F.avg("after").alias("a"))
    b, a = F.round("b", 1), F.round("a", 1)
    return means.select(course, "files", "fixed", b.alias("before"), a.alias("after"), F.round(a - b, 1).alias("gain"))


def a11y_multi_course(forecast: DataFrame) -> DataFrame:
    """Mean of course means, not of files."""
    return forecast.agg(F.count(F.lit(1)).alias("courses"), F.sum("files").alias("files"),
                        F.round(F.avg("before"), 1).alias("before"), F.round(F.avg("after"), 1).alias("after"))


def unscanned_courses(courses: DataFrame, forecast: DataFrame, course: str) -> DataFrame:
    """Courses without a scored file of any kind; they are no part of the mean."""
    return courses.select(course).distinct().join(forecast.select(course), course, "left_anti")


def worst_files(scored: DataFrame, course: str, key: str, top: int = WORST) -> DataFrame:
    order = W.partitionBy(course).orderBy("after", key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select(
        course, "place", key, "before", "after")
