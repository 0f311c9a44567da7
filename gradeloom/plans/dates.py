"""Plans over due dates: what a student is held to, extensions, and week-by-week due tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.dates import in_window, same_instant, shift_days, to_utc

# How a module names its week, and the module that has none.
WEEK_NUMBER = r"(?i)\bweek\s*(\d{1,2})\b"
START_HERE = r"(?i)^\s*start\s*here"


def effective_due(people: DataFrame, targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """The due and lock date each enrolled student is held to.

    ``people``: course_id, user_id, section_ids. ``targets``: course_id, assignment_id, due_at,
    lock_at, time_zone. ``overrides``: assignment_id, override_id, title, student_ids, section_id,
    due_at, lock_at. Overrides reach people through two equi-joins; the most lenient wins and no
    due date at all beats every date.
    """
    pairs = people.join(targets, "course_id")
    lenient = F.struct(F.col("o_due").isNull().alias("open"), F.col("o_due").alias("due"), F.col("override_id").alias("id"))
    found = F.struct("override_id", "title", "o_due", "o_lock", "how", "shared_with")
    named = overrides.select("assignment_id", "override_id", "title", F.col("due_at").alias("o_due"), F.col("lock_at").alias("o_lock"),
                             "section_id", "student_ids")
    adhoc = named.select("assignment_id", "override_id", "title", "o_due", "o_lock", F.lit("adhoc").alias("how"),
                         F.greatest(F.lit(0), F.size("student_ids") - 1).alias("shared_with"),
                         F.explode(F.array_distinct("student_ids")).alias("user_id"))
    section = named.where("section_id IS NOT NULL").select(
        "assignment_id", "override_id", "title", "o_due", "o_lock", F.lit("section").alias("how"), F.lit(0).alias("shared_with"),
        "section_id", "student_ids")
    in_section = people.select("course_id", "user_id", F.explode("section_ids").alias("section_id"))
    by_section = (section.join(targets.select("course_id", "assignment_id"), "assignment_id")
                  .join(in_section, ["course_id", "section_id"])
                  .where(~F.array_contains(F.coalesce("student_ids", F.array().cast("array<string>")), F.col("user_id")))
                  .select(adhoc.columns))
    best = adhoc.unionByName(by_section).groupBy("assignment_id", "user_id").agg(F.max_by(found, lenient).alias("o"))
    rows = pairs.join(best, ["assignment_id", "user_id"], "left")
    has = F.col("o").isNotNull()
    return rows.select(
        "course_id", "assignment_id", "user_id", "time_zone", F.coalesce("o.how", F.lit("everyone")).alias("how"),
        F.when(has, F.col("o.o_due")).otherwise(F.col("due_at")).alias("due_at"),
        F.coalesce("o.o_lock", "lock_at").alias("lock_at"),
        F.when(F.col("o.how") == "adhoc", F.col("o.override_id")).alias("override_id"),
        F.coalesce("o.shared_with", F.lit(0)).alias("shared_with"))


def touches_window(effective: DataFrame, targets: DataFrame, windows: DataFrame) -> DataFrame:
    """Assignments whose class date or any student's own date falls inside the course's window.

    ``windows``: course_id, start, end, one row per course, joined on the course.
    """
    dates = targets.select("course_id", "assignment_id", "time_zone", "due_at").unionByName(
        effective.select("course_id", "assignment_id", "time_zone", "due_at"))
    hit = in_window(F.col("due_at"), F.col("time_zone"), F.col("start"), F.col("end"))
    return dates.join(windows, "course_id").groupBy("course_id", "assignment_id").agg(F.max(hit).alias("in_window")).where("in_window") \
        .select("course_id", "assignment_id")


def extension_plan(effective: DataFrame, submitted: DataFrame, days: int, include_submitted: bool = False) -> DataFrame:
    """Students times their courses' targets: the moved dates, or why a row is left alone.

    ``effective`` already holds enrolled pairs only; see ``not_enrolled`` for the rest.
    """
    done = submitted.select("assignment_id", "user_id").distinct().withColumn("_done", F.lit(True))
    rows = effective.join(done, ["assignment_id", "user_id"], "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    why = (F.when(F.col("due_at").isNull(), "no due date").when(F.col("shared_with") > 0, "shared override")
           .when(F.col("_done") & ~F.lit(include_submitted), "already turned in"))
    to_due = F.when(why.isNull(), shift_days(F.col("due_at"), days, F.col("time_zone")))
    to_lock = F.when(why.isNull(), shift_days(F.col("lock_at"), days, F.col("time_zone")))
    action = F.when(why.isNull(), F.when(F.col("override_id").isNotNull(), "update").otherwise("create"))
    return rows.select("course_id", "assignment_id", "user_id", why.alias("why"), action.alias("action"),
                       F.col("due_at").alias("from_due"), to_due.alias("to_due"), F.col("lock_at").alias("from_lock"),
                       F.when(to_lock.isNotNull(), F.greatest(to_lock, to_due)).alias("to_lock"))


def not_enrolled(students: DataFrame, people: DataFrame, targets: DataFrame) -> DataFrame:
    """Per chosen student, how many targets lie in courses they are not in (counted, not paired)."""
    per_course = targets.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"))
    total = per_course.agg(F.sum("n").alias("all_targets"))
    mine = people.select("course_id", "user_id").join(per_course, "course_id").groupBy("user_id").agg(F.sum("n").alias("mine"))
    # ``total`` is a single row, so this is a scalar and not a product of two tables.
    return students.select("user_id").join(mine, "user_id", "left").join(F.broadcast(total)).select(
        "user_id", (F.col("all_targets") - F.coalesce("mine", F.lit(0))).alias("not_in_course"))


def week_due_dates(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Due day per week of a term.

    ``terms``: start date, weeks int, finals_end date, breaks array<date>, weekday int (0 Monday).
    Weeks that are all break are stepped over, a due day on a holiday moves to the next class day,
    and the last week is due on the last day of finals. One term is one row of short arrays, so
    nothing is shuffled.
    """
    c = F.col
    week_later = F.date_add("start", 7)
    anchor = F.date_add(week_later, F.pmod(c("weekday") - F.weekday(week_later), F.lit(7)))
    t = terms.withColumn("_ws", F.date_sub(F.date_sub(anchor, F.weekday(anchor)), 7))
    n = c("weeks") + 2 + F.floor(F.size("breaks") / 5).cast("int")
    t = t.withColumn("_mondays", F.transform(F.sequence(F.lit(0), n), lambda i: F.date_add(c("_ws"), i * 7)))
    work_week = lambda m: F.size(F.array_intersect(F.sequence(m, F.date_add(m, 4)), c("breaks"))) < 5
    t = t.withColumn("_open", F.filter("_mondays", work_week))
    rows = t.select(*keys, "weekday", "breaks", "finals_end", "weeks", F.explode(F.sequence(F.lit(1), c("weeks"))).alias("week"),
                    "_open")
    rows = rows.withColumns({"_this": F.get("_open", c("week") - 1), "_next": F.get("_open", c("week"))})
    rows = rows.withColumn("_plain", F.date_add("_next", c("weekday")))
    rows = rows.withColumn("_span", F.sequence(c("_plain"), F.date_add("_plain", F.size("breaks") * 3 + 7)))
    class_days = F.filter("_span", lambda d: ~F.array_contains(c("breaks"), d) & ((c("weekday") >= 5) | (F.weekday(d) < 5)))
    last = c("week") == c("weeks")
    due = F.when(last, c("finals_end")).otherwise(F.get(class_days, F.lit(0)))
    rows = rows.withColumn("due_date", due)
    skipped = F.datediff("_next", "_this") > 7
    moved = F.when(last, "final: due on the last day of finals").otherwise(F.concat_ws(
        "; ", F.when(skipped, "steps over a full break week"),
        F.when(c("due_date") != c("_plain"), F.concat(F.lit("moved off a holiday ("), c("_plain").cast("string"), F.lit(")")))))
    return rows.select(*keys, "week", "due_date", moved.alias("moved"))


def due_date_plan(modules: DataFrame, items: DataFrame, assignments: DataFrame, quizzes: DataFrame,
                  table: DataFrame, zone: Column, time: str = "23:59") -> DataFrame:
    """Dated items of "Week N" modules: current against computed date, each item dated once.

    ``modules``: course_id, module_id, name, position. ``items``: module_id, type, content_id.
    ``assignments``: course_id, assignment_id, quiz_id, due_at. ``quizzes``: course_id, quiz_id,
    due_at. ``table``: course_id, week, due_date.
    """
    weeks = modules.where(~F.col("name").rlike(START_HERE) & F.col("name").rlike(WEEK_NUMBER)).select(
        "course_id", "module_id", "position", F.regexp_extract("name", WEEK_NUMBER, 1).cast("int").alias("week")).where("week > 0")
    rows = weeks.join(items.where(F.col("type").isin("Assignment", "Quiz")), "module_id")
    a = assignments.select("course_id", F.col("assignment_id").alias("content_id"), F.lit("Assignment").alias("type"),
                           F.col("quiz_id").alias("a_quiz"), F.col("due_at").alias("a_due"))
    rows = rows.join(a, ["course_id", "content_id", "type"], "left")
    rows = rows.withColumn("quiz_id", F.when(F.col("type") == "Quiz", F.col("content_id")).otherwise(F.col("a_quiz")))
    q = quizzes.select("course_id", "quiz_id", F.col("due_at").alias("q_due"))
    rows = rows.join(q, ["course_id", "quiz_id"], "left").select(
        "course_id", "module_id", "position", "week",
        F.when(F.col("quiz_id").isNotNull(), "quiz").otherwise("assignment").alias("kind"),
        F.coalesce("quiz_id", "content_id").alias("item_id"), F.coalesce("q_due", "a_due").alias("current"))
    first = rows.groupBy("course_id", "kind", "item_id").agg(
        F.min(F.struct("position", "module_id")).alias("at"), F.min_by(F.struct("week", "current"), F.struct("position", "module_id")).alias("x"),
        (F.count_distinct("module_id") - 1).alias("also_in"))
    dated = first.select("course_id", F.col("at.module_id").alias("module_id"), F.col("x.week").alias("week"), "kind", "item_id",
                         F.col("x.current").alias("current"), "also_in").join(table, ["course_id", "week"], "left")
    proposed = to_utc(F.to_timestamp(F.concat(F.col("due_date").cast("string"), F.lit(f" {time}:00"))), zone)
    return dated.select("course_id", "module_id", "week", "kind", "item_id", "current", proposed.alias("proposed"), "also_in",
                        (F.col("due_date").isNotNull() & ~same_instant(F.col("current"), proposed)).alias("write"))
