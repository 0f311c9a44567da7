"""Attendance books over many courses: class days, marks, totals and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mark statuses, weekday names in order, and the limits of a book.
STATUSES = ("present", "tardy", "absent", "excused")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MAX_SPAN = 240
MAX_NOTE = 200
MAX_MINUTES = 180

MARK = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "minutes", "note", "updated")])
BOOK = T.StructType([
    T.StructField("weekdays", T.ArrayType(T.StringType())), T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()), T.StructField("skip_breaks", T.BooleanType()),
    T.StructField("marks", T.MapType(T.StringType(), T.MapType(T.StringType(), MARK)))])


def clean_day(text: Column) -> Column:
    """A yyyy-mm-dd day within 2000..2100, else null."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(F.year(day).between(2000, 2100), day)


def read_attendance_book(raw: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Nested JSON books to one clean mark per row; anything that is not a mark drops out."""
    books = raw.select(*keys, F.from_json(json, BOOK).alias("b"))
    days = books.select(*keys, F.explode("b.marks").alias("day", "cell"))
    marks = days.select(*keys, clean_day(F.trim("day")).alias("day"), F.explode("cell").alias("user_id", "m"))
    status = F.lower(F.trim(F.coalesce("m.status", F.lit(""))))
    minutes = F.greatest(F.lit(0), F.least(F.lit(MAX_MINUTES), F.coalesce(F.expr("try_cast(m.minutes as int)"), F.lit(0))))
    note = F.substring(F.trim(F.regexp_replace(F.coalesce("m.note", F.lit("")), r"\s+", " ")), 1, MAX_NOTE)
    rows = marks.select(*keys, "day", "user_id", status.alias("status"),
                        F.when(status == "tardy", minutes).otherwise(0).alias("minutes"), note.alias("note"),
                        F.coalesce("m.updated", F.lit("")).alias("updated"))
    return rows.where(F.col("day").isNotNull() & F.col("user_id").rlike(r"^\d{1,20}$")
                      & F.col("status").isin(*STATUSES, ""))


def rejected_patterns(patterns: DataFrame, course: str) -> DataFrame:
    """Patterns that give no class days, and why."""
    why = (F.when(F.col("start").isNull() | F.col("end").isNull(), "no dates").when(F.col("start") > F.col("end"), "ends before it starts")
           .when(F.datediff("end", "start") > MAX_SPAN, f"longer than {MAX_SPAN} days"))
    return patterns.select(course, "start", "end", why.alias("why")).where("why IS NOT NULL")


def meeting_dates(patterns: DataFrame, course: str, breaks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Class days: the weekday pattern, minus breaks where asked, plus or minus single days.

    Calendar rows are bounded by the span limit per course, so the pattern side is small
    next to marks; everything is keyed by course.
    """
    ok = patterns.where((F.col("start") <= F.col("end")) & (F.datediff("end", "start") <= MAX_SPAN))
    days = ok.select(course, "weekdays", "skip_breaks", F.explode(F.sequence("start", "end")).alias("day"))
    index = F.array(*[F.lit(n) for n in WEEKDAYS])
    days = days.where(F.array_contains("weekdays", F.element_at(index, F.weekday("day") + 1)))
    off = breaks.select(course, "day").distinct().withColumn("_break", F.lit(True))
    plain = (days.join(off, [course, "day"], "left")
             .where(~(F.col("skip_breaks") & F.coalesce("_break", F.lit(False)))).select(course, "day"))
    single = overrides.select(course, "day", "on")
    kept = plain.join(single.where("NOT on"), [course, "day"], "left_anti")
    return kept.unionByName(single.where("on").select(course, "day")).distinct()


def attendance_totals(marks: DataFrame, meetings: DataFrame, roster: DataFrame, course: str) -> DataFrame:
    """Per student counts on class days; unmarked students stay, at zero."""
    counted = marks.where("status <> ''").join(meetings.select(course, "day"), [course, "day"], "left_semi")
    per = counted.groupBy(course, "user_id").agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in STATUSES],
        F.sum(F.when(F.col("status") == "tardy", F.col("minutes")).otherwise(0)).alias("minutes"))
    people = roster.select(course, "user_id").unionByName(marks.select(course, "user_id")).distinct()
    return people.join(per, [course, "user_id"], "left").na.fill(0, [*STATUSES, "minutes"])


def attendance_summary(totals: DataFrame, meetings: DataFrame, course: str) -> DataFrame:
    days = meetings.groupBy(course).agg(F.count(F.lit(1)).alias("class_days"))
    sums = totals.groupBy(course).agg(F.sum("absent").alias("absences"), F.sum("tardy").alias("tardies"))
    return sums.join(days, course, "left").na.fill(0, ["class_days"])


def attendance_counts(marks: DataFrame, meetings: DataFrame, course: str) -> DataFrame:
    """Absences and tardies for the risk score; a course without class days counts every marked day."""
    has_days = meetings.select(course).distinct().withColumn("_has", F.lit(True))
    on_day = meetings.select(course, "day").withColumn("_on", F.lit(True))
    rows = (marks.where(F.col("status").isin("absent", "tardy"))
            .join(has_days, course, "left").join(on_day, [course, "day"], "left")
            .where("_has IS NULL OR _on"))
    return rows.groupBy(course, "user_id").agg(F.count_if(F.col("status") == "absent").alias("absent"),
                                               F.count_if(F.col("status") == "tardy").alias("tardy"))


def fill_present(marks: DataFrame, explicit: DataFrame, roster: DataFrame, course: str, day: Column,
                 stamp: Column) -> DataFrame:
    """One day's marks after a save: explicit, else a real earlier mark, else present.

    Three sources are ranked and the best kept per student, in one grouped pass.
    """
    cols = [course, "user_id"]
    old = marks.where(F.col("day") == day).select(*cols, F.when(F.col("status") != "", 2).otherwise(0).alias("rank"),
                                                  "status", "minutes", "note", "updated")
    new = explicit.select(*cols, F.lit(3).alias("rank"), "status", "minutes", "note", stamp.alias("updated"))
    fill = roster.where(F.col("user_id").rlike(r"^\d{1,20}$")).select(
        *cols, F.lit(1).alias("rank"), F.lit("present").alias("status"), F.lit(0).alias("minutes"),
        F.lit("").alias("note"), stamp.alias("updated"))
    rows = old.unionByName(new).unionByName(fill)
    best = rows.groupBy(*cols).agg(
        F.max_by(F.struct("status", "minutes", "note", "updated"), "rank").alias("m"),
        # a saved mark without its own note or minutes keeps the earlier ones
        F.max(F.when(F.col("rank").isin(0, 2), F.struct("note", "minutes"))).alias("was"))
    status = F.col("m.status")
    return best.select(course, day.alias("day"), "user_id", status.alias("status"),
                       F.when(status == "tardy", F.coalesce("m.minutes", "was.minutes", F.lit(0))).otherwise(0).alias("minutes"),
                       F.coalesce("m.note", "was.note", F.lit("")).alias("note"), F.col("m.updated").alias("updated"))


def days_made_class_days(saved: DataFrame, course: str, stamp: Column) -> DataFrame:
    """A real mark makes its day a class day."""
    return saved.where("status <> ''").select(course, "day").distinct().select(
        course, "day", F.lit(True).alias("on"), stamp.alias("updated"))
