"""Schedule, calendar and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import courses as names
from gradeloom.functions import dates
from gradeloom.operators import calendar, schedule
from gradeloom.plans import accommodations
from gradeloom.plans import dates as plans
from gradeloom.queries.registry import query


def c(n):
    return F.col(n)


# ------------------------------------------------------------------- courses
@query("term_of", "SELECT course_id, code, label, sort FROM course_terms", "courses course_terms")
def term_of(feed):
    return with_terms(feed)


def with_terms(feed):
    return feed.courses.select("course_id", names.term_of(c("course_code"), c("name"), c("term_name")).alias("t")).select("course_id", "t.*")


@query("course_title", "SELECT course_id, code, label FROM course_names", "courses course_names")
def course_title(feed):
    rows = feed.courses.select("course_id", "name", names.course_badge(c("course_code"), c("name"), c("course_id")).alias("code"))
    return rows.select("course_id", "code", names.course_title(c("name"), c("code")).alias("label"))


@query("item_kind", "SELECT assignment_id, kind, exam, proctored FROM assignments", "assignments")
def item_kind(feed):
    kind = names.item_kind(c("name"), c("submission_types"), c("is_quiz"))
    return feed.assignments.select("assignment_id", kind.alias("kind"), kind.isin(*names.EXAM_KINDS).alias("exam"),
                                   c("name").rlike(names.PROCTORED).alias("proctored"))


IT = "courses course_names assignments items"


def items(feed):
    return schedule.schedule_rows(feed.courses, feed.assignments)


@query("schedule_rows", "SELECT * FROM items ORDER BY due_at, code, name", IT)
def schedule_rows(feed):
    return items(feed).orderBy("due_at", "code", "name")


@query("schedule_stats", """SELECT count(*) AS total, count(*) FILTER (WHERE l) AS remaining, count(*) FILTER (WHERE l AND due_at <= TIMESTAMP '2026-10-08') AS next_7_days,
 count(*) FILTER (WHERE l AND exam) AS exams_left, CAST(sum(needs_grading) AS BIGINT) AS needs_grading FROM (SELECT *, due_at >= TIMESTAMP '2026-10-01' AS l FROM items)""", IT)
def schedule_stats(feed):
    return schedule.schedule_stats(items(feed), [], F.lit("2026-10-01").cast("timestamp"))


@query("schedule_legend", """SELECT course_id, coalesce(n,0) AS count, CAST(coalesce(g,0) AS BIGINT) AS needs_grading FROM courses LEFT JOIN
 (SELECT course_id, count(*) AS n, sum(needs_grading) AS g FROM items GROUP BY 1) USING (course_id)""", IT)
def schedule_legend(feed):
    return schedule.schedule_legend(feed.courses, items(feed))


@query("term_summary", """SELECT label, code, sort, count, row_number() OVER (ORDER BY sort DESC, label DESC) AS place,
 row_number() OVER (ORDER BY coalesce(code='202510', false) DESC, sort DESC, label DESC) = 1 AS is_default
 FROM (SELECT label, max(code) AS code, max(sort) AS sort, count(*) AS count FROM course_terms GROUP BY 1)""", "courses course_terms")
def term_summary(feed):
    return schedule.term_summary(with_terms(feed), dates.current_term_code(F.lit("2025-05-20").cast("date")))


@query("taught_students", """SELECT user_id, any_value(name) AS name, list_sort(list_distinct(list(course_id))) AS courses, any_value(g.percent) IS NOT NULL AS accommodated
 FROM enrolled LEFT JOIN grants g USING (user_id) GROUP BY user_id""", "enrolled grants")
def taught_students(feed):
    return schedule.taught_students(feed.enrolled, feed.grants)


@query("class_view", """SELECT course_id, user_id, count(*) FILTER (WHERE ok) AS graded, count(*) FILTER (WHERE fl) AS flagged,
 round(avg(CASE WHEN ok THEN 100.0::DOUBLE*l_quantity/50 END),1) AS average FROM (SELECT p_brand AS course_id, CAST(l_suppkey AS VARCHAR) AS user_id, l_quantity,
 l_returnflag<>'N' AS ok, l_linestatus='O' AS fl FROM lineitem JOIN part ON l_partkey=p_partkey) GROUP BY ALL""")
def class_view(feed):
    rows = feed.lineitem.join(feed.part, c("l_partkey") == c("p_partkey")).select(
        c("p_brand").alias("course_id"), c("l_suppkey").cast("string").alias("user_id"), "l_quantity", "l_returnflag",
        F.array_compact(F.array(F.when(c("l_linestatus") == "O", "by hand"))).alias("flags"))
    return schedule.class_view(rows, c("l_returnflag") != "N", c("l_quantity"), F.lit(50.0))


@query("student_search", """SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE contains(lower(c_name), '#00000012') ORDER BY lower(c_name), c_custkey LIMIT 40""")
def student_search(feed):
    return schedule.student_search(feed.customer.select(c("c_custkey").alias("user_id"), c("c_name").alias("name")), "#00000012")


@query("roster_sorted", """SELECT c_custkey AS user_id, name, lower(split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1)) AS sort_key
 FROM (SELECT c_custkey, 'Ann ' || c_mktsegment || c_custkey AS name FROM customer) ORDER BY sort_key, user_id""")
def roster_sorted(feed):
    return schedule.roster_sorted(feed.customer.select(c("c_custkey").alias("user_id"), F.concat(F.lit("Ann "), "c_mktsegment", c("c_custkey").cast("string")).alias("name")))


FIG = """SELECT c.course_id, coalesce(a.n,0) AS assignments, CAST(coalesce(a.g,0) AS BIGINT) AS to_grade, coalesce(d.g,0) AS graded_here, coalesce(d.w,0) AS waiting,
 coalesce(w.n,0) AS writes_today, d.last_graded FROM courses c
 LEFT JOIN (SELECT course_id, count(*) AS n, sum(needs_grading) AS g FROM assignments GROUP BY 1) a USING (course_id)
 LEFT JOIN (SELECT CAST(l_partkey%97 AS VARCHAR) AS course_id, count(*) FILTER (WHERE l_returnflag<>'N') AS g, count(*) FILTER (WHERE l_returnflag<>'N' AND l_linestatus<>'F') AS w,
  max(l_shipdate) AS last_graded FROM lineitem GROUP BY 1) d USING (course_id)
 LEFT JOIN (SELECT CAST(user_id%97 AS VARCHAR) AS course_id, count(*) AS n FROM events WHERE CAST(ts AS DATE)=DATE '2024-01-10' GROUP BY 1) w USING (course_id)"""


def figures(feed):
    drafts = feed.lineitem.select((c("l_partkey") % 97).cast("string").alias("course_id"), F.when(c("l_returnflag") != "N", c("l_quantity")).alias("total"),
                                  (c("l_linestatus") == "F").alias("synced"), c("l_shipdate").alias("graded_at"))
    writes = feed.events.where("to_date(ts) = DATE'2024-01-10'").select((c("user_id") % 97).cast("string").alias("course_id"), c("ts").alias("at"))
    return schedule.course_figures(feed.courses, feed.assignments, drafts, writes)


@query("course_figures", FIG, "courses assignments")
def course_figures(feed):
    return figures(feed)


@query("resume_course", f"SELECT x.course_id, x.l AS last_graded FROM (SELECT max({{'l': last_graded, 'course_id': course_id}}) AS x FROM ({FIG}) WHERE last_graded IS NOT NULL)", "courses assignments")
def resume_course(feed):
    return schedule.resume_course(figures(feed).where("last_graded IS NOT NULL"))


# --------------------------------------------------------------------- dates
EFF = "enrolled targets overrides effective"


def effective(feed):
    return plans.effective_due(feed.members, feed.targets, feed.overrides)


@query("effective_due", "SELECT * FROM effective", EFF)
def effective_due(feed):
    return effective(feed)


LOCAL = "CAST(timezone(time_zone, timezone('UTC', due_at)) AS DATE)"


@query("in_window", f"""SELECT DISTINCT course_id, assignment_id FROM (SELECT course_id, assignment_id, time_zone, due_at FROM effective UNION ALL SELECT course_id, assignment_id, time_zone, due_at FROM targets)
 WHERE {LOCAL} BETWEEN DATE '2026-10-26' AND DATE '2026-10-28'""", EFF)
def in_window(feed):
    windows = feed.targets.select("course_id").distinct().select(
        "course_id", F.lit("2026-10-26").cast("date").alias("start"), F.lit("2026-10-28").cast("date").alias("end"))
    return plans.touches_window(effective(feed), feed.targets, windows)


def _moved(col):
    return f"timezone('UTC', timezone(time_zone, timezone(time_zone, timezone('UTC', {col})) + INTERVAL 3 DAY))"


@query("extension_plan", f"""SELECT course_id, assignment_id, user_id, why, CASE WHEN why IS NULL THEN CASE WHEN override_id IS NOT NULL THEN 'update' ELSE 'create' END END AS action,
 due_at AS from_due, CASE WHEN why IS NULL THEN {_moved('due_at')} END AS to_due, lock_at AS from_lock,
 CASE WHEN why IS NULL AND lock_at IS NOT NULL THEN greatest({_moved('lock_at')}, {_moved('due_at')}) END AS to_lock FROM
 (SELECT f.*, CASE WHEN due_at IS NULL THEN 'no due date' WHEN shared_with>0 THEN 'shared override' WHEN s.submitted_at IS NOT NULL THEN 'already turned in' END AS why
  FROM effective f LEFT JOIN submissions s USING (assignment_id, user_id))""", f"{EFF} submissions")
def extension_plan(feed):
    return plans.extension_plan(effective(feed), feed.submissions.where("submitted_at IS NOT NULL"), 3)


@query("extension_not_enrolled", """SELECT CAST(s_suppkey AS VARCHAR) AS user_id, CAST((SELECT count(*) FROM part) - coalesce(n,0) AS BIGINT) AS not_in_course FROM supplier LEFT JOIN
 (SELECT user_id, count(*) AS n FROM enrolled GROUP BY 1) ON user_id = CAST(s_suppkey AS VARCHAR)""", "enrolled")
def extension_not_enrolled(feed):
    return plans.not_enrolled(feed.supplier.select(c("s_suppkey").cast("string").alias("user_id")), feed.members, feed.targets)


@query("shift_days", f"SELECT assignment_id, time_zone, due_at, {_moved('due_at')} AS moved, CAST(timezone(time_zone, timezone('UTC', due_at)) AS DATE) AS local_day FROM targets", "targets")
def shift_days(feed):
    return feed.targets.select("assignment_id", "time_zone", "due_at", dates.shift_days(c("due_at"), 3, c("time_zone")).alias("moved"),
                               dates.local_day(c("due_at"), c("time_zone")).alias("local_day"))


@query("to_utc", """SELECT o_orderkey, timezone('UTC', timezone('America/Chicago', o_orderdate + INTERVAL 23 HOUR + INTERVAL 59 MINUTE)) AS utc FROM orders""")
def to_utc(feed):
    wall = c("o_orderdate") + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
    return feed.orders.select("o_orderkey", dates.to_utc(wall, F.lit("America/Chicago")).alias("utc"))


@query("relative_age", """SELECT event_id, CASE WHEN h<1 THEN 'just now' WHEN h<36 THEN CAST(round_even(h,0) AS INT) || CASE WHEN round_even(h,0)=1 THEN ' hour ago' ELSE ' hours ago' END
 ELSE CAST(round_even(h/24,0) AS INT) || ' days ago' END AS age, greatest(0, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00')/86400000000.0) AS INT)) AS days
 FROM (SELECT *, (epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)))/3600.0 AS h FROM events)""")
def relative_age(feed):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return feed.events.select("event_id", dates.relative_age(c("ts"), now).alias("age"), dates.days_since(c("ts"), now).alias("days"))


@query("expand_breaks", """SELECT o_orderkey, CASE WHEN month(d)>=8 THEN 'Fall ' WHEN month(d)<=4 THEN 'Spring ' ELSE 'Summer ' END || year(d) AS term,
 CASE WHEN o_orderkey%3=0 THEN [d] WHEN o_orderkey%3=1 THEN [d, d+1, d+2] ELSE [d-2, d-1, d] END AS days FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def expand_breaks(feed):
    d = F.to_date("o_orderdate")
    typed = (F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("'"), d.cast("string"), F.lit("'; ")))
             .when(c("o_orderkey") % 3 == 1, F.concat(d.cast("string"), F.lit(" to "), F.date_add(d, 2).cast("string")))
             .otherwise(F.concat(d.cast("string"), F.lit(".."), F.date_sub(d, 2).cast("string"))))
    return feed.orders.select("o_orderkey", dates.term_name(d).alias("term"), dates.break_days(dates.parse_breaks_text(typed)).alias("days"))


def terms(feed):
    """A due table per nation: start and length follow its keys; a break week and two holidays."""
    n = c("n_nationkey")
    day = lambda s: F.lit(s).cast("date")
    breaks = F.concat(F.array(day("2026-09-07")), F.sequence(day("2026-11-23"), day("2026-11-27")), F.array(F.date_add(day("2026-10-05"), n)))
    return feed.nation.select("n_nationkey", F.date_add(day("2026-08-17"), n % 5).alias("start"), (n % 4 + 13).alias("weeks"),
                              day("2026-12-11").alias("finals_end"), breaks.alias("breaks"), (n % 7).alias("weekday"))


WEEKS = """open_weeks AS (SELECT n_nationkey, wd, breaks, weeks, m, row_number() OVER (PARTITION BY n_nationkey ORDER BY m) AS week,
   lead(m) OVER (PARTITION BY n_nationkey ORDER BY m) AS nxt FROM (SELECT *, CAST(unnest(generate_series(ws, ws + 7*20, INTERVAL 7 DAY)) AS DATE) AS m FROM
   (SELECT *, a - CAST(isodow(a)-1 AS INT) - 7 AS ws FROM (SELECT *, s7 + CAST((wd - (isodow(s7)-1) + 7) % 7 AS INT) AS a FROM
    (SELECT n_nationkey, DATE '2026-08-17' + n_nationkey%5 + 7 AS s7, n_nationkey%7 AS wd, n_nationkey%4+13 AS weeks,
     list_concat([DATE '2026-09-07', DATE '2026-10-05' + n_nationkey], [DATE '2026-11-23', DATE '2026-11-24', DATE '2026-11-25', DATE '2026-11-26', DATE '2026-11-27']) AS breaks FROM nation))))
   WHERE len(list_filter(breaks, lambda b: b BETWEEN m AND m+4)) < 5),
 due AS (SELECT n_nationkey, week, weeks, nxt + CAST(wd AS INT) AS plain, nxt - m > 7 AS skipped,
   (SELECT min(CAST(d AS DATE)) FROM (SELECT unnest(generate_series(nxt + CAST(wd AS INT), nxt + CAST(wd AS INT) + 20, INTERVAL 1 DAY)) AS d)
    WHERE NOT list_contains(breaks, CAST(d AS DATE)) AND (wd >= 5 OR isodow(d) < 6)) AS dd FROM open_weeks WHERE week <= weeks),
 week_table AS (SELECT n_nationkey, CAST(week AS INT) AS week, CASE WHEN week=weeks THEN DATE '2026-12-11' ELSE dd END AS due_date, CASE WHEN week=weeks THEN 'final: due on the last day of finals' ELSE
  concat_ws('; ', CASE WHEN skipped THEN 'steps over a full break week' END, CASE WHEN dd<>plain THEN 'moved off a holiday (' || plain || ')' END) END AS moved FROM due)"""


@query("week_due_dates", f"WITH {WEEKS} SELECT * FROM week_table")
def week_due_dates(feed):
    return plans.week_due_dates(terms(feed), ["n_nationkey"])


@query("due_date_plan", f"""WITH {WEEKS}, rows AS (SELECT s_nationkey AS course_id, CAST(l_suppkey AS VARCHAR) AS module_id, l_suppkey AS position, CAST(l_suppkey%16 AS INT) AS week,
   CASE WHEN p_type='ECONOMY' OR p_size%3=0 THEN 'quiz' ELSE 'assignment' END AS kind, CASE WHEN p_type='ECONOMY' THEN CAST(p_partkey AS VARCHAR) WHEN p_size%3=0 THEN 'q' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS item_id,
   CASE WHEN p_type='ECONOMY' THEN TIMESTAMP '2026-09-15 04:59:00' ELSE TIMESTAMP '2026-09-01 04:59:00' + to_days(p_size) END AS current
   FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey WHERE p_type<>'PROMO' AND l_suppkey%16>0),
  firsts AS (SELECT course_id, kind, item_id, min({{'p': position, 'module_id': module_id, 'week': week, 'current': current}}) AS x, count(DISTINCT module_id)-1 AS also_in FROM rows GROUP BY ALL)
 SELECT course_id, x.module_id AS module_id, x.week AS week, kind, item_id, x.current AS current, timezone('UTC', timezone('America/Chicago', due_date + INTERVAL 23 HOUR + INTERVAL 59 MINUTE)) AS proposed, also_in,
  due_date IS NOT NULL AND x.current IS DISTINCT FROM timezone('UTC', timezone('America/Chicago', due_date + INTERVAL 23 HOUR + INTERVAL 59 MINUTE)) AS write
 FROM firsts LEFT JOIN week_table w ON w.n_nationkey = course_id AND w.week = x.week""")
def due_date_plan(feed):
    course = feed.supplier.select(c("s_nationkey").alias("course_id"), c("s_suppkey"))
    modules = course.select("course_id", c("s_suppkey").cast("string").alias("module_id"), c("s_suppkey").alias("position"),
                            F.concat(F.lit("Week "), (c("s_suppkey") % 16).cast("string"), F.lit(": topics")).alias("name"))
    pairs = feed.lineitem.select("l_suppkey", "l_partkey").distinct().join(feed.part, c("l_partkey") == c("p_partkey"))
    key = c("p_partkey").cast("string")
    kind = F.when(c("p_type") == "ECONOMY", "Quiz").when(c("p_type") == "PROMO", "Page").otherwise("Assignment")
    rows = pairs.select(c("l_suppkey").cast("string").alias("module_id"), kind.alias("type"), key.alias("content_id"), "p_size", "l_suppkey")
    own = rows.join(course, c("l_suppkey") == c("s_suppkey")).select("course_id", "type", "content_id", "p_size").distinct()
    assignments = own.where("type = 'Assignment'").select("course_id", c("content_id").alias("assignment_id"), F.when(c("p_size") % 3 == 0, F.concat(F.lit("q"), "content_id")).alias("quiz_id"),
                                                          F.expr("timestamp'2026-09-01 04:59:00' + make_dt_interval(p_size)").alias("due_at"))
    quizzes = own.where("type = 'Quiz'").select("course_id", c("content_id").alias("quiz_id"), F.lit("2026-09-15 04:59:00").cast("timestamp").alias("due_at"))
    table = plans.week_due_dates(terms(feed), ["n_nationkey"]).withColumnRenamed("n_nationkey", "course_id").drop("moved")
    return plans.due_date_plan(modules, rows.select("module_id", "type", "content_id"), assignments, quizzes, table, F.lit("America/Chicago"))


# ------------------------------------------------------------ accommodations
ACC = """SELECT course_id, quiz_id, user_id, extra_time, extra_attempts, manually_unlocked, CASE WHEN extra_time IS NULL AND extra_attempts IS NULL AND manually_unlocked IS NULL THEN 'no time limit'
  WHEN (extra_time IS NULL OR coalesce(ht,0)=extra_time) AND (extra_attempts IS NULL OR extra_attempts=0) AND manually_unlocked IS NULL THEN 'already set' END AS why FROM
 (SELECT q.course_id, q.quiz_id, g.user_id, CASE WHEN kind='minutes' THEN nullif(minutes,0) WHEN time_limit>0 THEN CAST(ceil(time_limit*0.5) AS INT) END AS extra_time, nullif(extra_attempts,0) AS extra_attempts,
   CASE WHEN manually_unlocked THEN true END AS manually_unlocked, CASE WHEN (CAST(q.quiz_id AS INT)+CAST(g.user_id AS INT))%3=0 THEN 10 END AS ht
  FROM grants g JOIN (SELECT DISTINCT course_id, user_id FROM enrolled) e USING (user_id) JOIN quizzes q ON q.course_id=e.course_id)"""
ACC_USES = "enrolled grants quizzes"


def acc_plan(feed):
    members = feed.members.select("course_id", "user_id")
    held = members.join(feed.quizzes, "course_id").where("(cast(quiz_id as int) + cast(user_id as int)) % 3 = 0").select(
        "quiz_id", "user_id", F.lit(10).alias("extra_time"), F.lit(0).alias("extra_attempts"), F.lit(False).alias("manually_unlocked"))
    return accommodations.accommodation_plan(feed.grants, members, feed.quizzes, held)


@query("accommodation_plan", ACC, ACC_USES)
def accommodation_plan(feed):
    return acc_plan(feed)


@query("accommodation_batches", f"""SELECT course_id, quiz_id, count(*) AS n, CAST(sum(extra_time) AS BIGINT) AS minutes,
 list_sort(list({{'user_id': user_id, 'extra_time': extra_time, 'extra_attempts': extra_attempts}})) AS extensions FROM ({ACC}) WHERE why IS NULL GROUP BY ALL""", ACC_USES)
def accommodation_batches(feed):
    return accommodations.accommodation_batches(acc_plan(feed))


@query("extra_minutes", "SELECT p_partkey, CAST(ceil(p_size*0.5) AS INT) AS half, CASE WHEN p_size>2 THEN p_size END AS fixed FROM part")
def extra_minutes(feed):
    half = accommodations.extra_minutes(F.lit("percent"), F.lit(50), F.lit(0), c("p_size"))
    fixed = accommodations.extra_minutes(F.lit("minutes"), F.lit(50), F.when(c("p_size") > 2, c("p_size")).otherwise(0), c("p_size"))
    return feed.part.select("p_partkey", half.alias("half"), fixed.alias("fixed"))


@query("accommodation_reject", """SELECT reject, count(*) AS n FROM (SELECT CASE WHEN c_custkey%5=0 THEN 'not a user id' WHEN c_custkey%7=0 THEN 'unknown kind' WHEN c_acctbal::INT NOT BETWEEN 1 AND 400 THEN 'percent out of range'
  WHEN c_custkey%30>20 THEN 'attempts out of range' END AS reject FROM customer) GROUP BY 1""")
def accommodation_reject(feed):
    k = c("c_custkey")
    rows = feed.customer.select(F.when(k % 5 == 0, "guest").otherwise(k.cast("string")).alias("user_id"), F.when(k % 7 == 0, "other").otherwise("percent").alias("kind"),
                                F.round("c_acctbal").cast("int").alias("percent"), F.lit(0).alias("minutes"), (k % 30).cast("int").alias("extra_attempts"))
    return accommodations.reject_reason(rows).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ calendar
@query("term_calendar", """SELECT term, finals_end, n, on_break FROM (SELECT term, max(d) AS finals_end, count(*) AS n, count(*) FILTER (WHERE d BETWEEN b AND b+2) AS on_break FROM
 (SELECT term, d, min(d) OVER (PARTITION BY term)+10 AS b FROM (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN month(o_orderdate)>=8 THEN 'Fall ' WHEN month(o_orderdate)<=4 THEN 'Spring ' ELSE 'Summer ' END || year(o_orderdate) AS term FROM orders)) GROUP BY term)""")
def term_calendar(feed):
    dated = feed.orders.select(F.to_date("o_orderdate").alias("d"))
    span = dated.groupBy(dates.term_name(c("d")).alias("term")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    entry = F.struct(c("b").cast("string").alias("finalsEnd"), F.array(F.concat_ws("..", F.date_add("a", 10).cast("string"), F.date_add("a", 12).cast("string"))).alias("breaks"))
    raw = span.select(F.to_json(F.create_map("term", entry)).alias("json"))
    hit = calendar.lookup_term(dated, "d", calendar.term_table(raw, [], "json"))
    return hit.groupBy("term", "finals_end").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("break_days", c("d"))).alias("on_break"))


@query("break_days_from_pages", """SELECT page_id, 'Fall 2026' AS term, d AS day, name FROM (SELECT page_id, unnest([{'d': DATE '2026-09-07', 'name': 'Labor Day'}, {'d': DATE '2026-10-12' + CAST(page_id%3 AS INT), 'name': 'Fall break'},
  {'d': DATE '2026-10-13' + CAST(page_id%3 AS INT), 'name': 'Fall break'}, {'d': DATE '2026-11-25', 'name': 'Thanksgiving'}, {'d': DATE '2026-11-26', 'name': 'Thanksgiving'}], recursive := true) FROM pages)""")
def break_days_from_pages(feed):
    shift = (c("page_id") % 3 + 12).cast("string")
    row = lambda d, t: F.concat(F.lit("<tr><td>"), d, F.lit(f"</td><td>{t}</td></tr>"))
    html = F.concat(c("html"), F.lit("<h2>Fall 2026 Academic Schedule</h2><table>"),
                    row(F.lit("Monday, August 17, 2026"), "Classes begin"), row(F.lit("Monday, September 7, 2026"), "Labor Day Holiday (closed)"),
                    row(F.concat(F.lit("Monday, October "), shift, F.lit(", 2026")), "Fall BEGIN holidays"), row(F.concat(F.lit("Tuesday, October "), (c("page_id") % 3 + 13).cast("string"), F.lit(", 2026")), "Fall break ENDS"),
                    row(F.lit("Wednesday, November 25, 2026"), "Thanksgiving holidays BEGIN"), row(F.lit("Thursday, November 26, 2026"), "Thanksgiving holidays END; offices closed"), F.lit("</table>"))
    return calendar.break_days_from_pages(feed.pages.select("page_id", html.alias("html")), "page_id", "html")


INDEX = """SELECT p_partkey, p_name || ' & co' AS name, p_type AS cip_class, CAST(p_size AS VARCHAR) AS cip, CASE WHEN p_size%2=0 THEN ['AB' || chr(CAST(65+p_size%26 AS INT)), 'MAT'] ELSE ['AB' || chr(CAST(65+p_size%26 AS INT))] END AS prefixes,
 '/curriculum/' || p_partkey AS slug FROM part WHERE p_size%5<>0"""


def catalogue(feed):
    letter = F.char(c("p_size") % 26 + 65)
    html = F.concat(F.lit('<a class="curriculum-card" href="/curriculum/'), c("p_partkey").cast("string"), F.lit('"><span class="cip-card-title"><strong>Name:</strong>'),
                    F.when(c("p_size") % 5 == 0, "tbd").otherwise(F.concat("p_name", F.lit(" &amp; co"))), F.lit('</span><span class="cip-card-name">'), "p_type", F.lit('</span><span class="cip-card-code">'),
                    c("p_size").cast("string"), F.lit('</span><span class="cip-card-prefix">ab'), F.lower(letter), F.when(c("p_size") % 2 == 0, ", mat").otherwise(""), F.lit("</span></a>"))
    return calendar.program_index(feed.part.select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("program_index", INDEX)
def program_index(feed):
    return catalogue(feed)


@query("program_resolve", f"""SELECT course_id, course_code, prefix, coalesce(n,0) AS candidates, CASE WHEN n=1 THEN 'unique' WHEN n>1 THEN 'ambiguous' ELSE 'none' END AS verdict, CASE WHEN n=1 THEN first END AS program FROM
 (SELECT CAST(s_suppkey AS VARCHAR) AS course_id, CASE s_suppkey%3 WHEN 0 THEN 'MAT 1313' WHEN 1 THEN 'ab' || chr(CAST(97+s_suppkey%26 AS INT)) || ' 1000' ELSE 'XYZ 9' END AS course_code FROM supplier)
 LEFT JOIN LATERAL (SELECT upper(regexp_extract(course_code, '^([A-Za-z]{{2,4}})', 1)) AS prefix) ON true
 LEFT JOIN (SELECT prefix, count(*) AS n, min(name) AS first FROM (SELECT unnest(prefixes) AS prefix, name FROM ({INDEX})) GROUP BY 1) USING (prefix)""")
def program_resolve(feed):
    code = (F.when(c("s_suppkey") % 3 == 0, "MAT 1313").when(c("s_suppkey") % 3 == 1, F.concat(F.lit("ab"), F.char(c("s_suppkey") % 26 + 97), F.lit(" 1000"))).otherwise("XYZ 9"))
    return calendar.program_resolve(feed.supplier.select(c("s_suppkey").cast("string").alias("course_id"), code.alias("course_code")), catalogue(feed))
