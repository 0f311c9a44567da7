"""Attendance queries: events are marks, the tens digit of their property is the course."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import attendance
from gradeloom.queries.feed import EVENT_COURSE, event_course
from gradeloom.queries.registry import query

C = "course_id"
USES = "patterns meet_overrides meetings roster marks totals"


def meetings(feed):
    return attendance.meeting_dates(feed.patterns, C, feed.breaks, feed.meet_overrides)


def totals(feed):
    return attendance.attendance_totals(feed.marks, meetings(feed), feed.roster, C)


@query("meeting_dates", "SELECT course_id, day FROM meetings", "patterns meet_overrides meetings")
def meeting_dates(feed):
    return meetings(feed)


@query("rejected_patterns", """SELECT course_id, start_day AS start, end_day AS "end", CASE WHEN start_day > end_day THEN 'ends before it starts' ELSE 'longer than 240 days' END AS why
 FROM (SELECT course_id, start_day, CASE WHEN course_id IN ('2', '3') THEN start_day + 241 WHEN course_id = '4' THEN start_day + 240 WHEN course_id = '5' THEN start_day - 1 ELSE end_day END AS end_day FROM patterns)
 WHERE start_day > end_day OR end_day - start_day > 240""", "patterns")
def rejected_patterns(feed):
    """The feed's patterns, some of them stretched or turned round: those that ``meeting_dates`` has no days for, and why."""
    end = (F.when(F.col(C).isin("2", "3"), F.date_add("start", 241)).when(F.col(C) == "4", F.date_add("start", 240))
           .when(F.col(C) == "5", F.date_sub("start", 1)).otherwise(F.col("end")))
    return attendance.rejected_patterns(feed.patterns.withColumn("end", end), C)


@query("attendance_totals", "SELECT * FROM totals", USES)
def attendance_totals(feed):
    return totals(feed)


@query("attendance_summary", """SELECT t.course_id, CAST(absences AS BIGINT) AS absences, CAST(tardies AS BIGINT) AS tardies, coalesce(class_days,0) AS class_days FROM
 (SELECT course_id, sum(absent) AS absences, sum(tardy) AS tardies FROM totals GROUP BY 1) t LEFT JOIN
 (SELECT course_id, count(*) AS class_days FROM meetings GROUP BY 1) m USING (course_id)""", USES)
def attendance_summary(feed):
    return attendance.attendance_summary(totals(feed), meetings(feed), C)


@query("attendance_counts", """SELECT course_id, user_id, count(*) FILTER (WHERE status='absent') AS absent,
 count(*) FILTER (WHERE status='tardy') AS tardy FROM marks WHERE status IN ('absent','tardy') AND
 (course_id NOT IN (SELECT course_id FROM meetings) OR (course_id, day) IN (SELECT (course_id, day) FROM meetings)) GROUP BY ALL""", USES)
def attendance_counts(feed):
    return attendance.attendance_counts(feed.marks, meetings(feed), C)


@query("read_attendance_book", f"""SELECT event_id, course_id, day, user_id, status, CASE WHEN status='tardy' THEN m ELSE 0 END AS minutes, note, updated
 FROM (SELECT event_id, {EVENT_COURSE} AS course_id, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS user_id,
  CASE event_type WHEN 'view' THEN 'tardy' WHEN 'error' THEN 'absent' WHEN 'click' THEN 'present' ELSE '' END AS status,
  least(180, CAST(floor(value*10) AS INT)) AS m, 'k ' || props AS note, strftime(ts, '%Y-%m-%d') AS updated
  FROM events WHERE event_id % 50 <> 0 AND event_type <> 'signup' AND user_id % 29 <> 0)""")
def read_attendance_book(feed):
    status = (F.when(F.col("event_type") == "view", " Tardy ").when(F.col("event_type") == "error", "ABSENT")
              .when(F.col("event_type") == "click", "present").when(F.col("event_type") == "signup", "asleep").otherwise(""))
    day = F.when(F.col("event_id") % 50 == 0, "2024-13-01").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    uid = F.when(F.col("user_id") % 29 == 0, "guest").otherwise(F.col("user_id").cast("string"))
    mark = F.struct(status.alias("status"), F.floor(F.col("value") * 10).cast("string").alias("minutes"),
                    F.concat(F.lit("k \n "), "props").alias("note"), F.date_format("ts", "yyyy-MM-dd").alias("updated"))
    book = F.to_json(F.struct(F.create_map(day, F.create_map(uid, mark)).alias("marks")))
    raw = feed.events.select("event_id", event_course(), book.alias("json"))
    return attendance.read_attendance_book(raw, ["event_id", C], "json")


DAY = "2024-01-10"


@query("fill_present", f"""SELECT course_id, DATE '{DAY}' AS day, user_id, coalesce(e.status, nullif(m.status,''), 'present') AS status,
 CASE WHEN coalesce(e.status, m.status)='tardy' THEN coalesce(m.minutes,0) ELSE 0 END AS minutes, '' AS note,
 CASE WHEN e.status IS NULL AND m.status<>'' THEN m.updated ELSE TIMESTAMP '2024-02-01' END AS updated
 FROM (SELECT course_id, user_id FROM roster UNION SELECT course_id, user_id FROM marks WHERE day = DATE '{DAY}'
       UNION SELECT course_id, user_id FROM marks WHERE day = DATE '2024-01-11' AND status IN ('tardy','absent'))
 LEFT JOIN (SELECT * FROM marks WHERE day = DATE '{DAY}') m USING (course_id, user_id)
 LEFT JOIN (SELECT course_id, user_id, status FROM marks WHERE day = DATE '2024-01-11' AND status IN ('tardy','absent')) e USING (course_id, user_id)
 WHERE e.status IS NOT NULL OR m.status<>'' OR (course_id, user_id) IN (SELECT (course_id, user_id) FROM roster)
 UNION ALL SELECT course_id, DATE '{DAY}', user_id, '', 0, '', updated FROM marks WHERE day = DATE '{DAY}' AND status=''
  AND (course_id, user_id) NOT IN (SELECT (course_id, user_id) FROM roster)
  AND (course_id, user_id) NOT IN (SELECT (course_id, user_id) FROM marks WHERE day = DATE '2024-01-11' AND status IN ('tardy','absent'))""", USES)
def fill_present(feed):
    explicit = feed.marks.where("day = DATE'2024-01-11' AND status IN ('tardy','absent')").select(
        C, "user_id", "status", F.lit(None).cast("int").alias("minutes"), F.lit(None).cast("string").alias("note"))
    return attendance.fill_present(feed.marks, explicit, feed.roster, C, F.lit(DAY).cast("date"),
                                   F.lit("2024-02-01").cast("timestamp"))


@query("days_made_class_days", """SELECT DISTINCT course_id, day, true AS "on", TIMESTAMP '2024-02-01' AS updated FROM marks WHERE status<>''""", USES)
def days_made_class_days(feed):
    """Every day with a real mark is a class day, whatever the pattern says."""
    return attendance.days_made_class_days(feed.marks, C, F.lit("2024-02-01").cast("timestamp"))
