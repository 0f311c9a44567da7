"""Risk queries: orders are hand-ins, years the dated work, customers students in two courses each."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import attendance, risk
from gradeloom.queries import attendance as attendance_queries
from gradeloom.queries.feed import EVENT_COURSE, event_course
from gradeloom.queries.registry import query

STATS_USES = "work due_items coursework enrollment stats"
USES = f"{STATS_USES} risk"


def now():
    return F.lit("1999-07-01").cast("timestamp")


def scanned(feed):
    """Items of an earlier check: everything due before 1998."""
    return feed.due_items.where("published AND due_at <= TIMESTAMP'1998-01-01'")


def stats(feed):
    """Two scans: the first state is kept, the second folds only newly due items onto it, for all enrolled students."""
    def delta(items):
        sent = feed.coursework.join(items, ["course_id", "assignment_id"], "left_semi")
        return risk.fold_delta(risk.expected_submissions(sent, items, feed.enrollment))
    first = risk.fold_stats(None, delta(scanned(feed)), feed.enrollment, now())
    fresh = risk.due_unscanned(feed.due_items, scanned(feed).select("course_id", "assignment_id"), now())
    return risk.fold_stats(first, delta(fresh), feed.enrollment, now())


@query("due_unscanned", """SELECT course_id, assignment_id, due_at FROM due_items WHERE published AND due_at <= TIMESTAMP '1999-07-01'
 AND due_at > TIMESTAMP '1998-01-01'""", "work due_items")
def due_unscanned(feed):
    return risk.due_unscanned(feed.due_items, scanned(feed).select("course_id", "assignment_id"), now()).select(
        "course_id", "assignment_id", "due_at")


@query("risk_fold", "SELECT course_id, user_id, name, grade, missing_ids, zero_ids, last_submit, last_activity_at FROM stats", STATS_USES)
def risk_fold(feed):
    return stats(feed).select("course_id", "user_id", "name", "grade", "missing_ids", "zero_ids", "last_submit", "last_activity_at")


@query("risk_course", """SELECT course_id, user_id, grade, missing, zeros, score, reasons,
 CASE WHEN score>=50 THEN 'high' WHEN score>=25 THEN 'medium' ELSE 'low' END AS band FROM risk""", USES)
def risk_course(feed):
    return risk.risk_course(stats(feed)).select("course_id", "user_id", "grade", "missing", "zeros", "score", "reasons", "band")


ATT = """SELECT course_id, user_id, absent, tardy, CAST(least(72,absent*12)+least(16,tardy*2) AS INT) AS score,
 list_filter([CASE WHEN absent>0 THEN absent || CASE WHEN absent=1 THEN ' absence' ELSE ' absences' END END,
  CASE WHEN tardy>0 THEN tardy || CASE WHEN tardy=1 THEN ' tardy' ELSE ' tardies' END END], lambda x: x IS NOT NULL) AS reasons
 FROM (SELECT course_id, user_id, count(*) FILTER (WHERE status='absent') AS absent, count(*) FILTER (WHERE status='tardy') AS tardy
  FROM marks WHERE status IN ('absent','tardy') AND (course_id NOT IN (SELECT course_id FROM meetings)
   OR (course_id, day) IN (SELECT (course_id, day) FROM meetings)) GROUP BY ALL)"""
ATT_USES = "patterns meet_overrides meetings marks"


def attend(feed):
    counts = attendance.attendance_counts(feed.marks, attendance_queries.meetings(feed), "course_id")
    return counts.withColumns({"score": risk.attendance_score(F.col("absent"), F.col("tardy")),
                               "reasons": risk.attendance_reasons(F.col("absent"), F.col("tardy"))})


@query("risk_attendance", ATT, ATT_USES)
def risk_attendance(feed):
    return attend(feed)


OVERALL = f"""SELECT user_id, name, score, attend, n_courses, reasons, attend_reasons,
 CASE WHEN score>=50 THEN 'high' WHEN score>=25 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN attend>=50 THEN 'high' WHEN attend>=25 THEN 'medium' ELSE 'low' END AS attend_band,
 score>=50 OR attend>=50 AS look FROM
 (SELECT r.user_id, any_value(name) AS name, max(r.score) AS score, max(coalesce(a.score,0)) AS attend, count(*) AS n_courses,
  flatten(list(list_transform(r.reasons, lambda x: r.course_id || ': ' || x) ORDER BY r.score DESC, r.course_id))[:8] AS reasons,
  flatten(list(list_transform(coalesce(a.reasons, []), lambda x: r.course_id || ': ' || x) ORDER BY coalesce(a.score,0) DESC, r.course_id))[:6] AS attend_reasons
  FROM risk r LEFT JOIN ({ATT}) a USING (course_id, user_id) GROUP BY r.user_id)"""


def overall(feed):
    att = attend(feed).select("course_id", "user_id", F.col("score").alias("attend"), F.col("reasons").alias("attend_reasons"))
    rows = risk.risk_course(stats(feed)).join(att, ["course_id", "user_id"], "left").withColumns({
        "attend": F.coalesce("attend", F.lit(0)),
        "attend_reasons": F.coalesce("attend_reasons", F.array().cast("array<string>"))})
    return risk.risk_overall(rows)


@query("risk_overall", OVERALL, f"{USES} {ATT_USES}")
def risk_overall(feed):
    return overall(feed)


@query("risk_counts", f"""SELECT count(*) FILTER (WHERE band='high') AS high, count(*) FILTER (WHERE band='medium') AS medium,
 count(*) FILTER (WHERE band='low') AS low, count(*) FILTER (WHERE attend_band='high') AS attend_high,
 count(*) FILTER (WHERE attend_band='medium') AS attend_medium, count(*) FILTER (WHERE attend_band='low') AS attend_low,
 count(*) FILTER (WHERE look) AS look FROM ({OVERALL})""", f"{USES} {ATT_USES}")
def risk_counts(feed):
    return risk.risk_counts(overall(feed))


@query("look_first", f"SELECT user_id, name, score, attend FROM ({OVERALL}) ORDER BY greatest(score, attend) DESC, lower(name), user_id",
       f"{USES} {ATT_USES}")
def look_first(feed):
    return risk.look_first(overall(feed)).select("user_id", "name", "score", "attend")


WEEKS = f"""SELECT {EVENT_COURSE} AS course_id, user_id, date_trunc('week', ts) AS scanned_at, CAST(least(100, count(*)*7) AS INT) AS score
 FROM events GROUP BY ALL"""


@query("risk_trend", f"""SELECT * FROM (SELECT *, score - lag(score) OVER (PARTITION BY course_id, user_id ORDER BY scanned_at) AS trend,
 row_number() OVER (PARTITION BY course_id, user_id ORDER BY scanned_at DESC) AS age FROM ({WEEKS})) WHERE age <= 8""")
def risk_trend(feed):
    weeks = feed.events.groupBy(event_course(), "user_id", F.date_trunc("week", "ts").alias("scanned_at")).agg(
        F.least(F.lit(100), F.count(F.lit(1)) * 7).cast("int").alias("score"))
    return risk.risk_trend(weeks, ["course_id", "user_id"])


@query("flatten_submissions", """SELECT CAST(o_orderkey AS VARCHAR) AS assignment_id, CAST(o_custkey AS VARCHAR) AS user_id,
 o_totalprice AS score FROM orders""")
def flatten_submissions(feed):
    row = F.struct(F.col("o_orderkey").cast("string").alias("assignment_id"), F.col("o_custkey").cast("string").alias("user_id"),
                   F.col("o_totalprice").alias("score"))
    rows = feed.orders.select(row.alias("r"), F.col("o_custkey").alias("c"))
    none = F.lit(None)
    flat = rows.where("c % 2 = 0").select("r.*", none.cast("array<struct<assignment_id:string,user_id:string,score:double>>").alias("submissions"))
    nested = rows.where("c % 2 = 1").groupBy("c").agg(F.collect_list("r").alias("submissions")).select(
        none.cast("string").alias("assignment_id"), none.cast("string").alias("user_id"), none.cast("double").alias("score"), "submissions")
    return risk.flatten_submissions(flat.unionByName(nested))
