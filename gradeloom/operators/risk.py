"""Who needs a look: coursework and attendance risk per student, from folded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.dates import days_since

# Points per sign of trouble, their caps, and the bands.
GRADE_POINTS = ((60.0, 35), (70.0, 20), (80.0, 8))
MISSING_POINTS, MISSING_CAP = 10, 40
ZERO_POINTS, ZERO_CAP = 5, 20
QUIET_DAYS, NO_SUBMIT_POINTS, INACTIVE_POINTS = 14, 12, 8
ABSENT_POINTS, ABSENT_CAP = 12, 72
TARDY_POINTS, TARDY_CAP = 2, 16
HIGH, MEDIUM = 50, 25
KEPT_REASONS, KEPT_ATTEND_REASONS, HISTORY_CAP = 8, 6, 8


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))


def attendance_score(absent: Column, tardy: Column) -> Column:
    a, t = F.greatest(F.lit(0), F.coalesce(absent, F.lit(0))), F.greatest(F.lit(0), F.coalesce(tardy, F.lit(0)))
    return (F.least(F.lit(ABSENT_CAP), a * ABSENT_POINTS) + F.least(F.lit(TARDY_CAP), t * TARDY_POINTS)).cast("int")


def attendance_reasons(absent: Column, tardy: Column) -> Column:
    return F.array_compact(F.array(_plural(absent, " absence", " absences"), _plural(tardy, " tardy", " tardies")))


def course_score(grade: Column, missing: Column, zeros: Column, since_submit: Column, since_activity: Column) -> Column:
    low = F.lit(0)
    for cutoff, points in reversed(GRADE_POINTS):
        low = F.when(grade < cutoff, points).otherwise(low)
    missing, zeros = F.coalesce(missing, F.lit(0)), F.coalesce(zeros, F.lit(0))
    points = (F.coalesce(low, F.lit(0)) + F.least(F.lit(MISSING_CAP), missing * MISSING_POINTS)
              + F.least(F.lit(ZERO_CAP), zeros * ZERO_POINTS)
              + F.when((missing > 0) & (since_submit >= QUIET_DAYS), NO_SUBMIT_POINTS).otherwise(0)
              + F.when(since_activity >= QUIET_DAYS, INACTIVE_POINTS).otherwise(0))
    return F.least(F.lit(100), points).cast("int")


def course_reasons(grade: Column, missing: Column, zeros: Column, since_submit: Column, since_activity: Column) -> Column:
    top = max(c for c, _ in GRADE_POINTS)
    return F.array_compact(F.array(
        F.when(grade < top, F.concat(F.lit("grade "), F.bround(grade, 0).cast("long").cast("string"), F.lit("%"))),
        _plural(missing, " past-due item not turned in", " past-due items not turned in"),
        _plural(zeros, " zero", " zeros"),
        F.when((missing > 0) & (since_submit >= QUIET_DAYS),
               F.concat(F.lit("no submission in "), since_submit.cast("string"), F.lit(" days"))),
        F.when(since_activity >= QUIET_DAYS,
               F.concat(F.lit("no platform activity in "), since_activity.cast("string"), F.lit(" days")))))


def due_unscanned(assignments: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """Published, due by now and not part of an earlier check."""
    due = assignments.where(F.coalesce("published", F.lit(True)) & (F.col("due_at") <= now))
    return due.join(scanned, [c for c in ("course_id", "assignment_id") if c in scanned.columns], "left_anti")


def flatten_submissions(items: DataFrame) -> DataFrame:
    """Flat rows, and rows grouped per student with nested submissions, as one relation."""
    flat = items.where("assignment_id IS NOT NULL").select("assignment_id", "user_id", "score")
    nested = items.where("assignment_id IS NULL").select(F.inline("submissions"))
    return flat.unionByName(nested.select("assignment_id", "user_id", "score"))


def expected_submissions(submissions: DataFrame, due: DataFrame, enrolled: DataFrame) -> DataFrame:
    """One row per enrolled student and newly due item of the course: the submission, or an empty row where there is none.

    ``due``: course_id, assignment_id, points_possible. ``enrolled``: course_id, user_id. Rows of students who are not enrolled stay.
    A course's items times its students is the size of its gradebook, which a complete scan holds anyway.
    """
    keys = ["course_id", "assignment_id", "user_id"]
    wanted = (due.select("course_id", "assignment_id", F.col("points_possible").alias("_points")).distinct()
              .join(enrolled.select("course_id", "user_id").distinct(), "course_id"))
    rows = submissions.join(wanted, keys, "full_outer")
    return rows.withColumn("points_possible", F.coalesce("points_possible", "_points")).select(submissions.columns)


def fold_delta(submissions: DataFrame) -> DataFrame:
    """What newly due items say per (course, user), as id sets; one row per student item in.

    A student without a row is not seen here: complete the rows with ``expected_submissions`` first.
    """
    turned_in = F.col("submitted_at").isNotNull() | F.coalesce(
        F.col("workflow_state").isin("submitted", "graded", "pending_review"), F.lit(False))
    counts = ~F.coalesce("excused", F.lit(False))
    absent = counts & (F.coalesce("missing", F.lit(False)) | ~turned_in)
    zero = counts & ~absent & (F.col("points_possible") > 0) & F.coalesce(F.col("score") == 0, F.lit(False))
    aid = F.col("assignment_id")
    return submissions.groupBy("course_id", "user_id").agg(
        F.collect_set(F.when(absent, aid)).alias("new_missing"), F.collect_set(F.when(zero, aid)).alias("new_zero"),
        F.collect_set(F.when(counts, aid)).alias("touched"), F.max("submitted_at").alias("new_submit"))


def fold_stats(kept: DataFrame | None, delta: DataFrame, enrollment: DataFrame, now: Column) -> DataFrame:
    """Fold newly due items onto the kept state of the last scan."""
    empty = F.array().cast("array<string>")
    if kept is None:
        both = delta.withColumns({"missing_ids": empty, "zero_ids": empty, "last_submit": F.lit(None).cast("timestamp"),
                                  "kept_grade": F.lit(None).cast("double"), "kept_activity": F.lit(None).cast("timestamp")})
    else:
        both = delta.join(kept.select("course_id", "user_id", "missing_ids", "zero_ids", "last_submit",
                                      F.col("grade").alias("kept_grade"), F.col("last_activity_at").alias("kept_activity")),
                          ["course_id", "user_id"], "full_outer")
    c = lambda n: F.coalesce(F.col(n), empty)
    fold = lambda old, new: F.array_sort(F.array_union(F.array_except(c(old), c("touched")), c(new)))
    rows = both.join(enrollment.select("course_id", "user_id", "name", "current_score", "last_seen"),
                     ["course_id", "user_id"], "left")
    last = F.greatest("last_submit", "new_submit")
    seen = F.coalesce("last_seen", "kept_activity")
    out = rows.select(
        "course_id", "user_id", "name",
        F.when(F.col("current_score") <= 100, F.col("current_score")).otherwise(F.col("kept_grade")).alias("grade"),
        fold("missing_ids", "new_missing").alias("missing_ids"), fold("zero_ids", "new_zero").alias("zero_ids"),
        last.alias("last_submit"), seen.alias("last_activity_at"))
    return out.withColumns({
        "missing": F.size("missing_ids"), "zeros": F.size("zero_ids"),
        "days_since_submit": days_since(F.col("last_submit"), now),
        "days_since_activity": days_since(F.col("last_activity_at"), now)})


def risk_course(stats: DataFrame) -> DataFrame:
    args = [F.col(n) for n in ("grade", "missing", "zeros", "days_since_submit", "days_since_activity")]
    return stats.withColumns({"score": course_score(*args), "reasons": course_reasons(*args)}).withColumn(
        "band", band(F.col("score")))


def risk_overall(courses: DataFrame) -> DataFrame:
    """One row per student: the worst course decides, reasons ordered by course score.

    ``courses``: user_id, name, course_id, score, reasons, attend, attend_reasons. A student's
    courses are few, so the collected list is small.
    """
    def ordered(score, reasons, keep):
        said = F.transform(F.col(reasons), lambda r: F.concat_ws(": ", F.col("course_id"), r))
        rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("k"), F.col("course_id").alias("c"), said.alias("r"))))
        return F.slice(F.flatten(F.transform(rows, lambda x: x["r"])), 1, keep)
    people = courses.groupBy("user_id").agg(
        F.min_by("name", "course_id").alias("name"), F.max("score").alias("score"),
        F.max(F.coalesce("attend", F.lit(0))).alias("attend"), F.count(F.lit(1)).alias("n_courses"),
        ordered("score", "reasons", KEPT_REASONS).alias("reasons"),
        ordered("attend", "attend_reasons", KEPT_ATTEND_REASONS).alias("attend_reasons"))
    return people.withColumns({
        "band": band(F.col("score")), "attend_band": band(F.col("attend")),
        "look": (F.col("score") >= HIGH) | (F.col("attend") >= HIGH)})


def risk_counts(people: DataFrame) -> DataFrame:
    return people.agg(*[F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")],
                      *[F.count_if(F.col("attend_band") == b).alias(f"attend_{b}") for b in ("high", "medium", "low")],
                      F.count_if("look").alias("look"))


def look_first(people: DataFrame) -> DataFrame:
    return people.orderBy(F.greatest("score", "attend").desc(), F.lower("name"), "user_id")


def risk_trend(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the previous snapshot; the newest eight are kept."""
    order = W.partitionBy(*keys).orderBy("scanned_at")
    newest = W.partitionBy(*keys).orderBy(F.desc("scanned_at"))
    return (snapshots.withColumn("trend", F.col("score") - F.lag("score").over(order))
            .withColumn("age", F.row_number().over(newest)).where(F.col("age") <= HISTORY_CAP))
