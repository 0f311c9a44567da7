"""Gradebook queries: line items are submissions, parts are assignments, brands are courses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.functions import late_policy, scores
from gradeloom.operators import grading
from gradeloom.queries.registry import query
from gradeloom.sources import snapshots
from gradeloom.staging import shared_folder

A = ["assignment_id"]


def possible():
    return F.lit(68.0)


def rubric_map():
    return F.create_map(F.lit("c1"), F.lit(50.0), F.lit("c2"), F.lit(10.0), F.lit("c3"), F.lit(8.0))


def earned():
    return scores.earned_total(F.col("scores"), F.col("total"), F.col("total_only"), rubric_map())


def shown():
    return scores.final_total(F.col("scores"), F.col("total"), F.col("total_only"), rubric_map(), possible(),
                              F.col("curve_flat"), F.col("curve_by"))


def scored():
    return scores.is_scored(F.col("total"), F.col("source"))


def graded(feed):
    return feed.grades.where(scored())


@query("is_scored", "SELECT source, scored, count(*) AS n FROM final GROUP BY ALL", "grades final")
def is_scored(feed):
    return feed.grades.groupBy("source", scored().alias("scored")).agg(F.count(F.lit(1)).alias("n"))


@query("final_total", """SELECT assignment_id, count(*) AS n, sum(earned) AS earned, sum(shown) AS shown,
 count(*) FILTER (WHERE shown > earned) AS raised FROM final GROUP BY ALL""", "grades final")
def final_total(feed):
    rows = feed.grades.select("assignment_id", earned().alias("e"), shown().alias("s"))
    return rows.groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("earned"), F.sum("s").alias("shown"),
        F.count_if(F.col("s") > F.col("e")).alias("raised"))


DIST = """SELECT assignment_id, letter, cnt AS count, round(cnt / n, 6) AS share, low, high FROM
 (SELECT assignment_id, b.letter, b.low, b.high, count(*) FILTER (WHERE g.letter = b.letter) AS cnt, count(*) AS n
  FROM (SELECT assignment_id, CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D'
        ELSE 'F' END AS letter FROM (SELECT assignment_id, 100.0::DOUBLE * shown / 68 AS p FROM final WHERE scored)) g,
   (VALUES ('A', 90.0::DOUBLE, NULL::DOUBLE), ('B', 80.0, 90.0), ('C', 70.0, 80.0), ('D', 60.0, 70.0), ('F', 0.0, 60.0)) b(letter, low, high)
  GROUP BY ALL)"""


def distribution(feed):
    return grading.letter_distribution(graded(feed), A, scores.percent_of(shown(), possible())).withColumn(
        "share", F.round("share", 6))


@query("letter_distribution", DIST, "grades final")
def letter_distribution(feed):
    return distribution(feed)


@query("score_stats", """SELECT assignment_id, count(*) AS n, round(avg(shown),2) AS mean, round(median(shown),2) AS median,
 round(min(shown),2) AS min, round(max(shown),2) AS max, round(100.0*avg(shown)/68,1) AS mean_pct
 FROM final WHERE scored GROUP BY ALL""", "grades final")
def score_stats(feed):
    return grading.score_stats(graded(feed), A, shown(), possible())


HEALTH = """
SELECT course_id, assignment_id, criterion_id, label, points, n, round(m,2) AS mean, round(100.0*m/points,1) AS mean_pct,
 round(sx,2) AS spread, round(100.0*sx/points,1) AS spread_pct, mn AS min, mx AS max, at_ceiling, at_floor, r AS r_with_rest,
 list_filter([CASE WHEN at_ceiling=n THEN 'ceiling' WHEN sx/points<=0.08::DOUBLE AND n>2 THEN 'no_spread' END,
  CASE WHEN m/points<=0.25 THEN 'floor' WHEN m/points<0.7::DOUBLE THEN 'weak' END,
  CASE WHEN r IS NOT NULL AND n>=8 AND abs(r)<0.25 AND at_ceiling<>n THEN 'weak_link' END], lambda x: x IS NOT NULL) AS findings
FROM (SELECT *, CASE WHEN n>=3 THEN round(cov/nullif(sx*sy,0),3) END AS r FROM
 (SELECT course_id, assignment_id, criterion_id, label, points, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v),0) AS sx,
   stddev_samp(rest) AS sy, covar_samp(v,rest) AS cov, min(v) AS mn, max(v) AS mx,
   count(*) FILTER (WHERE v>=0.95::DOUBLE*points) AS at_ceiling, count(*) FILTER (WHERE v<=0.25*points) AS at_floor
  FROM (SELECT assignment_id, c.criterion_id, c.v, c1+c2+c3-c.v AS rest FROM
        (SELECT assignment_id, c1, c2, c3, unnest([{'criterion_id':'c1','v':c1},{'criterion_id':'c2','v':c2},{'criterion_id':'c3','v':c3}]) AS c
         FROM final WHERE scored)) JOIN rubric USING (assignment_id, criterion_id) GROUP BY ALL))"""


def health(feed):
    rows = graded(feed)
    return grading.rubric_health(rows, feed.rubric, A).join(
        feed.part.select(F.col("p_partkey").cast("string").alias("assignment_id"), F.col("p_brand").alias("course_id")), A)


@query("rubric_health", HEALTH, "rubric grades final")
def rubric_health(feed):
    return health(feed)


@query("course_patterns", f"""SELECT course_id, label, times_seen, times_weak, round(m + 1e-9, 1) AS mean_pct FROM
 (SELECT course_id, trim(regexp_replace(lower(label), '[^a-z0-9 ]', '', 'g')) AS label, count(*) AS times_seen,
  count(*) FILTER (WHERE mean_pct < 70) AS times_weak, avg(mean_pct) FILTER (WHERE mean_pct < 70) AS m
  FROM ({HEALTH}) WHERE n >= 3 GROUP BY ALL) WHERE times_seen >= 2 AND times_weak >= 2""", "rubric grades final")
def course_patterns(feed):
    return grading.course_patterns(health(feed), "course_id")


@query("weak_row_evidence", f"""SELECT assignment_id, weak_rank, criterion_id, mean_pct, place, user_id, scored FROM
 (SELECT w.assignment_id, w.weak_rank, w.criterion_id, w.mean_pct, f.user_id, f.v AS scored,
   row_number() OVER (PARTITION BY w.assignment_id, w.criterion_id ORDER BY f.v, f.user_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY assignment_id ORDER BY mean_pct, criterion_id) AS weak_rank
        FROM ({HEALTH}) WHERE mean_pct < 70) w
  JOIN (SELECT assignment_id, user_id, unnest([{{'c':'c1','v':c1}},{{'c':'c2','v':c2}},{{'c':'c3','v':c3}}], recursive := true)
        FROM final WHERE scored) f ON f.assignment_id = w.assignment_id AND f.c = w.criterion_id
  WHERE weak_rank <= 3) WHERE place <= 6""", "rubric grades final")
def weak_row_evidence(feed):
    return grading.weak_row_evidence(graded(feed), grading.rubric_health(graded(feed), feed.rubric, A), A, "user_id")


@query("flag_frequency", """SELECT assignment_id, flag, n FROM (SELECT *,
 row_number() OVER (PARTITION BY assignment_id ORDER BY n DESC, flag) AS r
 FROM (SELECT assignment_id, flag, count(*) AS n FROM (SELECT assignment_id, unnest(flags) AS flag FROM final WHERE scored) GROUP BY ALL)) WHERE r <= 8""", "grades final")
def flag_frequency(feed):
    return grading.flag_frequency(graded(feed), A)


UNSCORED = """SELECT assignment_id, count(*) FILTER (WHERE r='no_submission') AS no_submission,
 count(*) FILTER (WHERE r='nothing_readable') AS nothing_readable, count(*) FILTER (WHERE r='not_graded_yet') AS not_graded_yet
 FROM (SELECT assignment_id, CASE WHEN status='graded' THEN 'scored' WHEN coalesce(status,'unsubmitted')='unsubmitted' THEN 'no_submission'
  WHEN words > 4 THEN 'nothing_readable' ELSE 'not_graded_yet' END AS r
  FROM enrolled LEFT JOIN submissions USING (assignment_id, user_id)) GROUP BY ALL"""


def unscored(feed):
    rows = grading.complete_submissions(feed.enrolled, feed.submissions, ["assignment_id", "user_id"])
    return grading.unscored_counts(rows, A, F.col("status"), F.col("status") == "graded", F.col("words") > 4)


@query("unscored_counts", UNSCORED, "enrolled submissions")
def unscored_counts(feed):
    return unscored(feed)


@query("grade_summary", f"""SELECT d.*, u.no_submission, u.nothing_readable, u.not_graded_yet
 FROM ({DIST}) d LEFT JOIN ({UNSCORED}) u USING (assignment_id)""", "grades final enrolled submissions")
def grade_summary(feed):
    return distribution(feed).join(unscored(feed), A, "left")


@query("class_aggregate", """SELECT * FROM (SELECT assignment_id, count(*) AS enrolled, count(*) FILTER (WHERE t) AS submitted,
 count(*) FILTER (WHERE NOT t) AS missing, count(*) FILTER (WHERE t AND NOT scored) AS ungraded,
 count(*) FILTER (WHERE scored AND t) AS pool, round(avg(shown) FILTER (WHERE scored AND t),2) AS mean,
 round(median(shown) FILTER (WHERE scored AND t),2) AS median, min(shown) FILTER (WHERE scored AND t) AS low,
 max(shown) FILTER (WHERE scored AND t) AS high, round(avg(c1) FILTER (WHERE scored AND t),2) AS c1_mean,
 min(c1) FILTER (WHERE scored AND t) AS c1_min, max(c1) FILTER (WHERE scored AND t) AS c1_max
 FROM (SELECT *, source <> 'no-submission' OR curve_flat > 0 AS t FROM final) GROUP BY ALL) WHERE pool >= 3""", "grades final")
def class_aggregate(feed):
    status = F.when((F.col("source") == "no-submission") & (F.col("curve_flat") == 0), "unsubmitted").otherwise("graded")
    return grading.class_aggregate(feed.grades, A, shown(), scored(), status,
                                   criteria={"c1": F.col("scores")["c1"]})


GROUPED = "SELECT *, max(shown) OVER (PARTITION BY assignment_id) AS gmax, (sum(CAST(shown AS DECIMAL(18,2))) OVER (PARTITION BY assignment_id))::DOUBLE / count(*) OVER (PARTITION BY assignment_id) AS gmean FROM final WHERE scored"
RAW_SQL = {
    "flat": "b + 4", "scale": "b * 1.1::DOUBLE", "target_mean": "b + (0.75*68 - gmean)", "to_top": "b + greatest(0, 68 - gmax)",
    "sqrt": "sqrt(greatest(0, b/68.0))*68.0", "floor": "greatest(b, 0.65::DOUBLE*68)"}
CURVES = {"flat": (4.0, None), "scale": (10.0, None), "target_mean": (0.0, 75.0), "to_top": (0.0, None),
          "sqrt": (0.0, None), "floor": (0.0, 65.0)}


def _curve(kind, amount, target):
    plan_sql = f"""SELECT assignment_id, user_id, round(b,2) AS before, round(least(greatest(raw,b),68.0),2) AS after,
      round(least(greatest(raw,b),68.0)-b,2) AS delta, raw < b AS kept_from_lowering, raw > 68 AS capped
      FROM (SELECT *, {RAW_SQL[kind]} AS raw FROM (SELECT *, shown AS b FROM ({GROUPED})))"""

    def plan(feed):
        return grading.curve_plan(graded(feed), A, kind, shown(), possible(), amount, target).select(
            "assignment_id", "user_id", "before", "after", "delta", "kept_from_lowering", "capped")

    @query(f"curve_{kind}", f"""SELECT assignment_id, count(*) AS n_selected, count(*) FILTER (WHERE delta<>0) AS n_changed,
      count(*) FILTER (WHERE kept_from_lowering) AS n_lowered_blocked, count(*) FILTER (WHERE capped) AS n_capped,
      max(delta) AS biggest_gain, round(sum(CAST(delta AS DECIMAL(18,2)))::DOUBLE/count(*)+1e-9,2) AS mean_gain, round(sum(CAST(before AS DECIMAL(18,2)))::DOUBLE/count(*)+1e-9,2) AS mean_before,
      round(sum(CAST(after AS DECIMAL(18,2)))::DOUBLE/count(*)+1e-9,2) AS mean_after, round((median(CAST(round(before*100) AS BIGINT))/100.0+1e-9),2) AS median_before, round((median(CAST(round(after*100) AS BIGINT))/100.0+1e-9),2) AS median_after,
      round(100.0*sum(CAST(after AS DECIMAL(18,2)))::DOUBLE/count(*)/68+1e-9,1) AS mean_pct_after FROM ({plan_sql}) GROUP BY ALL""", "grades final")
    def effect(feed):
        return grading.curve_effect(plan(feed), A, possible())

    if kind == "to_top":
        query("curve_plan", plan_sql, "grades final")(plan)


for _kind, (_amount, _target) in CURVES.items():
    _curve(_kind, _amount, _target)


def policies(feed):
    return feed.syllabi.select("assignment_id", "course_id", late_policy.parse_late_policy(F.col("body")).alias("p"))


@query("late_policy", "SELECT * FROM policies", "syllabi policies")
def late_policies(feed):
    return policies(feed).select("assignment_id", "course_id", "p.*")


UNITS = """SELECT l.*, p.*, CASE WHEN seconds_late - grace_hours*3600 > 0
 THEN ceil((seconds_late - grace_hours*3600) / CASE WHEN interval='hour' THEN 3600 ELSE 86400 END) ELSE 0 END AS units
 FROM late_rows l JOIN policies p USING (assignment_id) WHERE late"""


@query("late_intervals", f"SELECT assignment_id, kind, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, CAST(max(units) AS BIGINT) AS most FROM ({UNITS}) GROUP BY ALL",
       "syllabi policies late_rows")
def late_intervals(feed):
    rows = feed.late_rows.where("late").join(policies(feed), A)
    units = scores.late_units(F.col("seconds_late"), F.col("p.grace_hours"), F.col("p.interval"))
    return rows.groupBy("assignment_id", F.col("p.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(units).alias("units"), F.max(units).alias("most"))


@query("late_deduction", f"""SELECT assignment_id, kind, flag, count(*) AS n, round(sum(points),2) AS points FROM
 (SELECT assignment_id, CASE WHEN none THEN 'none_accepted' ELSE kind END AS kind,
   CASE WHEN none THEN 'late penalty: not accepted' WHEN docks THEN 'late penalty applied' END AS flag,
   CASE WHEN none THEN round(total,2) WHEN docks AND kind='flat_percent' THEN round(total*percent/100.0,2)
    WHEN docks THEN round(total*least(percent*units, 100.0-floor_percent)/100.0,2) END AS points
  FROM (SELECT *, kind='none_accepted' OR coalesce(units > max_days, false) AS none,
     units > 0 AND kind IN ('flat_percent','percent_per_day','percent_per_hour') AS docks FROM ({UNITS}))) GROUP BY ALL""",
       "syllabi policies late_rows")
def late_deduction(feed):
    p = F.struct(*[F.col(f"p.{c}").alias(c) for c in ("kind", "percent", "interval", "grace_hours", "floor_percent", "max_days")],
                 F.lit(False).alias("lms_applies"))
    rows = feed.late_rows.join(policies(feed), A).select("assignment_id", scores.late_penalty(
        F.col("late"), F.col("seconds_late"), F.col("total"), p).alias("lp")).where("lp IS NOT NULL")
    return rows.groupBy("assignment_id", F.col("lp.kind").alias("kind"), F.col("lp.flag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("lp.points"), 2).alias("points"))


@query("grade_export", """SELECT assignment_id, user_id, CASE WHEN scored THEN earned END AS earned,
 CASE WHEN scored AND round(shown-earned,2)<>0 THEN round(shown-earned,2) END AS curve, CASE WHEN scored THEN shown END AS total,
 68.0::DOUBLE AS points_possible, CASE WHEN scored THEN p END AS percent, CASE WHEN NOT scored THEN NULL WHEN p>=90 THEN 'A' WHEN p>=80 THEN 'B'
 WHEN p>=70 THEN 'C' WHEN p>=60 THEN 'D' ELSE 'F' END AS letter, source, array_to_string(flags,'; ') AS flags,
 c1 AS "Depth of Work", c2 AS "Use of Sources", c3 AS "Form & Style", source || ' ' || 'reviewed' AS comment
 FROM (SELECT *, round(100.0*shown/68,1) AS p FROM final)""", "grades final")
def grade_export(feed):
    rows = feed.grades.withColumn("comment", F.concat_ws("\n", "source", F.lit("reviewed")))
    return grading.grade_export(rows, [("c1", "Depth of Work"), ("c2", "Use of Sources"), ("c3", "Form & Style")],
                                scored(), earned(), shown(), possible())


@query("grade_sheet", """SELECT assignment_id, user_id, name, CAST(row_number() OVER (PARTITION BY assignment_id ORDER BY lower(name), user_id, shown) AS INT) AS place, CASE WHEN scored THEN shown END AS total
 FROM (SELECT f.*, c_name AS name FROM final f JOIN orders ON o_orderkey = CAST(split_part(user_id, '-', 1) AS BIGINT) JOIN customer ON c_custkey=o_custkey)""", "grades final")
def grade_sheet(feed):
    """Sheets with names, written to the sink and read back."""
    people = feed.orders.join(feed.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("_k"), F.col("c_name").alias("name"))
    rows = feed.grades.withColumn("_k", F.substring_index("user_id", "-", 1).cast("bigint")).join(people, "_k").withColumn("comment", F.lit(""))
    sheet = grading.grade_export(rows, [("c1", "Depth of Work")], scored(), earned(), shown(), possible())
    path = f"{shared_folder(feed.spark)}/sheet-{uuid.uuid4().hex}"
    snapshots.write_grade_sheet(sheet, path)
    back = feed.spark.read.option("header", True).csv(path)
    return back.select(F.col("assignment_id").cast("string").alias("assignment_id"), "user_id", "name", F.col("place").cast("int").alias("place"), F.col("total").cast("double").alias("total"))


CRITERION = """SELECT *, b + 4 AS raw, CAST(split_part(user_id, '-', 2) AS INT) <= 4 AS picked FROM (SELECT *, greatest(0.0, least(c1 + curve_c1, 50.0)) AS b FROM final WHERE scored)"""
POOLED = f"""SELECT *, CASE WHEN delta=0 THEN shown ELSE round(least(68.0, greatest(0.0, CASE WHEN total_only THEN total ELSE greatest(0.0, least(c1+round(curve_c1+delta,4),50.0))+least(c2,10.0)+least(c3,8.0) END + curve_flat)),2) END AS curved
 FROM (SELECT *, CASE WHEN picked THEN round(least(greatest(raw,b),50.0)-b,2) ELSE 0 END AS delta FROM ({CRITERION}))"""


def letters_sql(value):
    p = f"round(100.0*{value}/68,10)"
    cuts = [(90, None), (80, 90), (70, 80), (60, 70), (None, 60)]
    parts = [" AND ".join(x for x in (f"{p}>={lo}" if lo else "", f"{p}<{hi}" if hi else "") if x) for lo, hi in cuts]
    return "[" + ", ".join(f"count(*) FILTER (WHERE {x})" for x in parts) + "]"


def picked():
    return F.substring_index("user_id", "-", -1).cast("int") <= 4


def criterion_plan(feed):
    before = F.greatest(F.lit(0.0), F.least(F.col("scores")["c1"] + F.coalesce(F.col("curve_by")["c1"], F.lit(0.0)), F.lit(50.0)))
    return grading.curve_plan(graded(feed), A, "flat", before, F.lit(50.0), 4.0, None, picked())


@query("curve_criterion", f"""SELECT assignment_id, user_id, round(b,2) AS before, round(least(greatest(raw,b),50.0),2) AS after, round(least(greatest(raw,b),50.0)-b,2) AS delta, raw > 50 AS capped
 FROM ({CRITERION}) WHERE picked""", "grades final")
def curve_criterion(feed):
    """A curve of one criterion for picked students, on top of the curve it has."""
    return criterion_plan(feed).select("assignment_id", "user_id", "before", "after", "delta", "capped")


@query("curve_pool", f"""SELECT assignment_id, count(*) AS n, count(*) FILTER (WHERE delta<>0) AS n_changed, round(sum(CAST(shown AS DECIMAL(18,2)))::DOUBLE/count(*)+1e-9,2) AS mean_before,
 round((median(CAST(round(shown*100) AS BIGINT))/100.0+1e-9),2) AS median_before, {letters_sql("shown")} AS letters_before, round(sum(CAST(curved AS DECIMAL(18,2)))::DOUBLE/count(*)+1e-9,2) AS mean_after,
 round((median(CAST(round(curved*100) AS BIGINT))/100.0+1e-9),2) AS median_after, {letters_sql("curved")} AS letters_after FROM ({POOLED}) GROUP BY 1""", "grades final")
def curve_pool(feed):
    """The criterion curve stacked on everyone's curve, and what it does to the whole pool."""
    total = lambda flat, by: scores.final_total(F.col("scores"), F.col("total"), F.col("total_only"), rubric_map(), possible(), flat, by)
    return grading.curve_pool(criterion_plan(feed), graded(feed).where(~picked()), A, "c1", total, possible())


LMS = """SELECT p.*, CAST(assignment_id AS INT)%3=0 AS lms, CASE WHEN CAST(assignment_id AS INT)%2=0 THEN 'hour' ELSE 'day' END AS lms_interval FROM policies p"""


@query("late_platform", f"""SELECT assignment_id, kind, flag, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, round(sum(points),2) AS points FROM
 (SELECT assignment_id, units, CASE WHEN lms THEN 'lms' WHEN none THEN 'none_accepted' ELSE kind END AS kind,
   CASE WHEN lms THEN NULL WHEN none THEN 'late penalty: not accepted' WHEN docks THEN 'late penalty applied' END AS flag,
   CASE WHEN lms THEN NULL WHEN none THEN round(total,2) WHEN docks AND kind='flat_percent' THEN round(total*percent/100.0,2)
    WHEN docks THEN round(total*least(percent*units, 100.0-floor_percent)/100.0,2) END AS points
  FROM (SELECT *, kind='none_accepted' OR coalesce(kind IN ('percent_per_day','percent_per_hour') AND units > max_days, false) AS none, units > 0 AND kind IN ('flat_percent','percent_per_day','percent_per_hour') AS docks FROM
   (SELECT *, CASE WHEN seconds_late - grace_hours*3600 > 0 THEN ceil((seconds_late - grace_hours*3600) / CASE WHEN i='hour' THEN 3600 ELSE 86400 END) ELSE 0 END AS units
    FROM (SELECT l.*, p.*, CASE WHEN lms THEN lms_interval ELSE interval END AS i FROM late_rows l JOIN ({LMS}) p USING (assignment_id) WHERE late)))) GROUP BY ALL""", "syllabi policies late_rows")
def late_platform(feed):
    """Where the platform deducts for lateness itself, the penalty is recorded and nothing is docked twice."""
    k = F.col("assignment_id").cast("int")
    lms = F.struct((k % 3 == 0).alias("enabled"), F.when(k % 2 == 0, "hour").otherwise("day").alias("interval"), F.lit(10.0).alias("percent"),
                   (k % 5 == 0).alias("floor_enabled"), F.lit(20.0).alias("floor_percent"))
    both = policies(feed).select("assignment_id", late_policy.with_lms_policy(F.col("p"), lms).alias("p"))
    rows = feed.late_rows.join(both, A).select("assignment_id", scores.late_penalty(F.col("late"), F.col("seconds_late"), F.col("total"), F.col("p")).alias("lp")).where("lp IS NOT NULL")
    return rows.groupBy("assignment_id", F.col("lp.kind").alias("kind"), F.col("lp.flag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lp.units").alias("units"), F.round(F.sum("lp.points"), 2).alias("points"))


AU = ["assignment_id", "user_id"]


@query("missing_work", """SELECT e.*, s.score, s.score IS NOT NULL AS graded FROM enrolled e LEFT JOIN submissions s USING (assignment_id, user_id)
 WHERE NOT coalesce(s.excused, false) AND s.submitted_at IS NULL""", "enrolled submissions")
def missing_work(feed):
    return grading.missing_work(feed.enrolled, feed.submissions, AU)


@query("complete_submissions", """SELECT e.*, coalesce(status,'unsubmitted') AS status, submitted_at, coalesce(attempt,0) AS attempt,
 coalesce(words,0) AS words FROM enrolled e LEFT JOIN submissions USING (assignment_id, user_id)""", "enrolled submissions")
def complete_submissions(feed):
    return grading.complete_submissions(feed.enrolled, feed.submissions, AU)




@query("late_waiver", """SELECT s_suppkey AS user_id, s_nationkey AS assignment_id,
 CASE WHEN s_suppkey % 4 = 0 THEN 'student' WHEN s_suppkey % 4 = 1 THEN 'assignment' ELSE '' END AS waived FROM supplier""")
def late_waiver(feed):
    name = F.concat(F.lit("Robin "), F.initcap(F.regexp_replace("s_name", "[^A-Za-z]", "")))
    text = (F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Please waive the tardy mark for "), name, F.lit("'s project.")))
            .when(F.col("s_suppkey") % 4 == 1, "Ignore late submissions for this assignment.")
            .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Do not waive the late penalty. "), F.lit("x" * 60), name))
            .otherwise(""))
    rows = feed.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("assignment_id"),
                                text.alias("t"), name.alias("name"))
    return rows.select("user_id", "assignment_id", F.when(late_policy.waives_name(F.col("t"), F.col("name")), "student")
                       .when(late_policy.waives_everyone(F.col("t")), "assignment").otherwise("").alias("waived"))
