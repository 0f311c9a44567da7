"""Schedules, terms and people across many courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.courses import EXAM_KINDS, PROCTORED, course_badge, course_title, item_kind


def schedule_rows(courses: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every item with a due date, named, classified and joined to its course."""
    named = courses.select("course_id", course_badge(F.col("course_code"), F.col("name"), F.col("course_id")).alias("code"),
                           F.col("name").alias("course_name")).withColumn("label", course_title(F.col("course_name"), F.col("code")))
    dated = assignments.where("due_at IS NOT NULL")
    kind = item_kind(F.col("name"), F.col("submission_types"), F.col("is_quiz"))
    rows = dated.select("course_id", "assignment_id", F.coalesce("name", F.lit("(untitled)")).alias("name"), "due_at",
                        F.coalesce("needs_grading", F.lit(0)).alias("needs_grading"), kind.alias("kind"),
                        kind.isin(*EXAM_KINDS).alias("exam"), F.coalesce(F.col("name").rlike(PROCTORED), F.lit(False)).alias("proctored"))
    return rows.join(named.drop("course_name"), "course_id")


def schedule_stats(items: DataFrame, keys: list[str], now: Column) -> DataFrame:
    left = F.col("due_at") >= now
    soon = left & (F.col("due_at") <= now + F.expr("INTERVAL 7 DAYS"))
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(left).alias("remaining"), F.count_if(soon).alias("next_7_days"),
        F.count_if(left & F.col("exam")).alias("exams_left"), F.sum("needs_grading").alias("needs_grading"))


def schedule_legend(courses: DataFrame, items: DataFrame) -> DataFrame:
    """Items and open grading per course; courses without a dated item stay."""
    per = items.groupBy("course_id").agg(F.count(F.lit(1)).alias("count"), F.sum("needs_grading").alias("needs_grading"))
    return courses.select("course_id").join(per, "course_id", "left").na.fill(0, ["count", "needs_grading"])


def term_summary(courses: DataFrame, current: Column) -> DataFrame:
    """Courses per term, newest first, and which term opens by default."""
    terms = courses.groupBy("label").agg(F.max("code").alias("code"), F.max("sort").alias("sort"), F.count(F.lit(1)).alias("count"))
    newest = W.orderBy(F.desc("sort"), F.desc("label"))
    # One row per term: a ranking of a few dozen rows.
    pick = W.orderBy(F.desc(F.coalesce(F.col("code") == current, F.lit(False))), F.desc("sort"), F.desc("label"))
    return terms.select("label", "code", "sort", "count", F.row_number().over(newest).alias("place"),
                        (F.row_number().over(pick) == 1).alias("is_default"))


def taught_students(enrolled: DataFrame, accommodations: DataFrame) -> DataFrame:
    """One row per person over all their courses."""
    people = enrolled.groupBy("user_id").agg(
        F.min_by("name", "course_id").alias("name"), F.array_sort(F.collect_set("course_id")).alias("courses"))
    flag = accommodations.select("user_id").distinct().withColumn("accommodated", F.lit(True))
    return people.join(flag, "user_id", "left").na.fill(False, ["accommodated"])


def class_view(entries: DataFrame, scored: Column, value: Column, possible: Column) -> DataFrame:
    """Per student of a course: graded and flagged counts and the average percent."""
    rows = entries.select("course_id", "user_id", scored.alias("_s"), F.size("flags").alias("_f"),
                          F.when(scored & (possible > 0), 100.0 * value / possible).alias("_p"))
    return rows.groupBy("course_id", "user_id").agg(
        F.count_if("_s").alias("graded"), F.count_if(F.col("_f") > 0).alias("flagged"), F.round(F.avg("_p"), 1).alias("average"))


def student_search(people: DataFrame, text: str, limit: int = 40) -> DataFrame:
    """People whose names or ids contain the text; sorted, then limited."""
    hay = F.lower(F.concat_ws(" ", *[c for c in ("name", "sortable_name", "nickname", "sis_user_id", "login_id") if c in people.columns]))
    return people.where(hay.contains(text.lower())).orderBy(F.lower(roster_sort_key()), "user_id").limit(limit)


def roster_sort_key() -> Column:
    """Family name first, from the sortable name or the last word of the name."""
    parts = F.split(F.trim(F.col("name")), r"\s+")
    last = F.element_at(parts, -1)
    return F.lower(F.concat_ws(" ", last, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")))


def roster_sorted(people: DataFrame) -> DataFrame:
    return people.withColumn("sort_key", roster_sort_key()).orderBy("sort_key", "user_id")


def course_figures(courses: DataFrame, assignments: DataFrame, drafts: DataFrame, writes: DataFrame) -> DataFrame:
    """One line per course from small grouped aggregates.

    ``drafts``: course_id, total, synced, graded_at. ``writes``: course_id, at (today's changes).
    """
    a = assignments.groupBy("course_id").agg(F.count(F.lit(1)).alias("assignments"), F.sum("needs_grading").alias("to_grade"))
    d = drafts.groupBy("course_id").agg(
        F.count_if(F.col("total").isNotNull()).alias("graded_here"),
        F.count_if(F.col("total").isNotNull() & ~F.coalesce("synced", F.lit(False))).alias("waiting"),
        F.max("graded_at").alias("last_graded"))
    w = writes.groupBy("course_id").agg(F.count(F.lit(1)).alias("writes_today"))
    rows = courses.select("course_id")
    for part in (a, d, w):
        rows = rows.join(part, "course_id", "left")
    return rows.na.fill(0, ["assignments", "to_grade", "graded_here", "waiting", "writes_today"])


def resume_course(figures: DataFrame) -> DataFrame:
    return figures.agg(F.max_by("course_id", F.struct("last_graded", "course_id")).alias("course_id"), F.max("last_graded").alias("last_graded"))
