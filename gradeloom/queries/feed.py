"""The driver's tables renamed to teaching data, once as DataFrames and once as SQL.

Each method of ``Feed`` has its counterpart in ``FEED_SQL``, so a query and its oracle
read the same relation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_SQL: dict[str, str] = {}


def s(col: str):
    return F.col(col).cast("string")


class Feed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    # ---------------------------------------------------------------- gradebook
    @cached_property
    def rubric(self) -> DataFrame:
        """Three criteria per assignment (part)."""
        crit = F.array(*[F.struct(F.lit(i).alias("criterion_id"), F.lit(n).alias("label"), F.lit(p).alias("points"))
                         for i, n, p in RUBRIC])
        return (self.part.select(F.col("p_brand").alias("course_id"), s("p_partkey").alias("assignment_id"),
                                 F.inline(crit)))

    @cached_property
    def grades(self) -> DataFrame:
        """One draft grade per line item; users are order lines, some carry an earlier curve."""
        return self.lineitem.select(
            s("l_partkey").alias("assignment_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("user_id"),
            F.when(F.col("l_returnflag") == "N", "no-submission").otherwise(
                F.when(F.col("l_linestatus") == "F", "ai").otherwise("lms")).alias("source"),
            F.create_map(F.lit("c1"), F.round("l_quantity", 2), F.lit("c2"), F.round(F.col("l_discount") * 100, 2),
                         F.lit("c3"), F.round(F.col("l_tax") * 100, 2)).alias("scores"),
            F.round(F.col("l_quantity") + F.col("l_discount") * 100 + F.col("l_tax") * 100, 2).alias("total"),
            (F.col("l_linenumber") == 5).alias("total_only"),
            F.when(F.col("l_linenumber") == 7, 5.0).otherwise(0.0).alias("curve_flat"),
            F.create_map(F.lit("c1"), F.when(F.col("l_linenumber") == 6, 3.0).otherwise(0.0)).alias("curve_by"),
            F.array_compact(F.array(
                F.when(F.col("l_quantity") < 5, "very short"), F.when(F.col("l_discount") > 0.08, "sources unclear"),
                F.when(F.col("l_linestatus") == "O", "check by hand"))).alias("flags"))

    @cached_property
    def syllabi(self) -> DataFrame:
        """Syllabus prose per assignment, its late rule set by the part's type and size."""
        size = s("p_size")
        return self.part.select(
            s("p_partkey").alias("assignment_id"), F.col("p_brand").alias("course_id"),
            F.when(F.col("p_type") == "ECONOMY", F.concat(
                F.lit("Late work will lose "), size, F.lit("% per day, up to 7 days.\nMinimum score of 40 percent.")))
            .when(F.col("p_type") == "PROMO", F.concat(
                F.lit("Late submissions: "), size, F.lit(" percent each hour,  with a 12 hour grace period.")))
            .when(F.col("p_type") == "MEDIUM", "No late work. Plan ahead.")
            .when(F.col("p_type") == "SMALL", "Anything late earns half credit.")
            .when(F.col("p_type") == "LARGE", "Late work is accepted without penalty in this course.")
            .when(F.col("p_size") % 2 == 0, F.concat(F.lit("If late, expect a "), size, F.lit("% penalty.")))
            .otherwise("Projects are due on Friday.").alias("body"))

    @cached_property
    def late_rows(self) -> DataFrame:
        """Graded submissions with lateness: ship date against order date."""
        seconds = F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
        return (lines.join(self.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
                .select(s("l_partkey").alias("assignment_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("user_id"),
                        (seconds > 0).alias("late"), seconds.alias("seconds_late"), F.col("l_quantity").alias("total")))

    @cached_property
    def enrolled(self) -> DataFrame:
        """Class lists: the students of a course, for each of its assignments. Courses hold 16 assignments and 20 students on average, so
        rows grow with the assignments."""
        parts = self.part.select(course_of().alias("course_id"), s("p_partkey").alias("assignment_id"), block_of().alias("_n"))
        return parts.join(self._people, "_n").select("course_id", "assignment_id", "user_id", "name")

    @property
    def _people(self) -> DataFrame:
        return self.supplier.select(s("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.expr("s_suppkey div 20").alias("_n"))

    @cached_property
    def submissions(self) -> DataFrame:
        """The latest hand-in per assignment and student of the course, of lines up to a date."""
        last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).alias("x")
        return (self.lineitem.groupBy("l_partkey", seat().alias("seat")).agg(last, F.count(F.lit(1)).alias("attempt"))
                .select(s("l_partkey").alias("assignment_id"), s("seat").alias("user_id"),
                        F.when(F.col("x.l_returnflag") != "R", F.col("x.l_shipdate")).alias("submitted_at"),
                        (F.col("x.l_linenumber") == 7).alias("excused"), F.col("x.l_quantity").alias("score"),
                        F.when(F.col("x.l_returnflag") == "R", "unsubmitted").when(F.col("x.l_returnflag") == "N", "graded")
                        .otherwise("submitted").alias("status"),
                        F.col("attempt").cast("int").alias("attempt"), F.col("x.l_linenumber").alias("words")))

    # --------------------------------------------------------------- attendance
    @cached_property
    def marks(self) -> DataFrame:
        """The newest mark per course, day and student, from the event stream."""
        status = (F.when(F.col("x.event_type") == "click", "present").when(F.col("x.event_type") == "view", "tardy")
                  .when(F.col("x.event_type") == "error", "absent").when(F.col("x.event_type") == "signup", "excused")
                  .otherwise(""))
        newest = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x")
        rows = self.events.select(event_course(), F.to_date("ts").alias("day"), s("user_id").alias("user_id"),
                                  "ts", "event_id", "event_type", "value")
        return (rows.groupBy("course_id", "day", "user_id").agg(newest)
                .select("course_id", "day", "user_id", status.alias("status"),
                        F.when(status == "tardy", F.least(F.floor("x.value"), F.lit(180)).cast("int")).otherwise(0).alias("minutes"),
                        F.lit("").alias("note"), F.col("x.ts").alias("updated")))

    @cached_property
    def roster(self) -> DataFrame:
        return self.events.where("event_type = 'signup'").select(event_course(), s("user_id").alias("user_id")).distinct()

    @cached_property
    def patterns(self) -> DataFrame:
        """Weekday patterns per course seen in the events; course 9 has none."""
        courses = self.events.select(event_course()).distinct()
        n = F.col("course_id").cast("int")
        days = (F.when(n == 9, F.array().cast("array<string>"))
                .when(n % 2 == 0, F.array(F.lit("mon"), F.lit("wed"))).otherwise(F.array(F.lit("tue"), F.lit("thu"))))
        return courses.select("course_id", days.alias("weekdays"), F.date_add(F.lit("2024-01-01").cast("date"), n).alias("start"),
                              F.lit("2024-01-26").cast("date").alias("end"), (n % 3 != 0).alias("skip_breaks"))

    @cached_property
    def breaks(self) -> DataFrame:
        days = F.sequence(F.lit("2024-01-15").cast("date"), F.lit("2024-01-16").cast("date"))
        return self.patterns.select("course_id", F.explode(days).alias("day"))

    @cached_property
    def meet_overrides(self) -> DataFrame:
        """Single days put on or off, the newest choice per day."""
        rows = self.events.where("event_type = 'purchase' AND value < 0.5 AND props <> '{\"k\": 90}'").select(
            event_course(), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("k"),
            (F.col("event_id") % 2 == 0).alias("on")).where("course_id <> '9'")
        return rows.groupBy("course_id", "day").agg(F.max_by("on", "k").alias("on"))

    # --------------------------------------------------------------------- risk
    def _work(self) -> DataFrame:
        """Orders as hand-ins: 25 customers are a section, which has a course for urgent and one for other work; a year is an item."""
        course = F.floor(F.col("o_custkey") / 25) * 2 + F.when(F.substring("o_orderpriority", 1, 1) < "3", 0).otherwise(1)
        return self.orders.withColumns({"course_id": course.cast("string"), "year": F.year("o_orderdate")}).withColumn(
            "assignment_id", F.concat_ws("-", "course_id", "year"))

    @cached_property
    def due_items(self) -> DataFrame:
        """Dated work per course; a few items are not published."""
        rows = self._work().select("course_id", "assignment_id", "year").distinct()
        return rows.select("course_id", "assignment_id", F.make_timestamp("year", F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("due_at"),
                           ((F.col("course_id").cast("int") + F.col("year") * 3) % 13 != 0).alias("published"), F.lit(100.0).alias("points_possible"))

    @cached_property
    def coursework(self) -> DataFrame:
        """The last hand-in of each customer for an item; who handed in nothing has no row."""
        last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")).alias("x")
        key, date, status = F.col("x.o_orderkey"), F.col("x.o_orderdate"), F.col("x.o_orderstatus")
        return self._work().groupBy("course_id", "assignment_id", s("o_custkey").alias("user_id")).agg(last).select(
            "course_id", "user_id", "assignment_id",
            F.when(status == "F", "graded").when(status == "O", "submitted").otherwise("unsubmitted").alias("workflow_state"),
            F.when(status != "P", date + F.make_dt_interval((key % 5).cast("int"))).alias("submitted_at"),
            (key % 17 == 0).alias("missing"), (key % 11 == 0).alias("excused"),
            F.when(key % 7 == 0, 0.0).otherwise(F.col("x.o_totalprice")).alias("score"), F.lit(100.0).alias("points_possible"))

    @cached_property
    def enrollment(self) -> DataFrame:
        """Every customer is in both courses of their section, with or without orders."""
        section = F.floor(F.col("c_custkey") / 25) * 2
        return self.customer.select(
            F.explode(F.array(section, section + 1).cast("array<string>")).alias("course_id"), s("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
            F.round(F.col("c_acctbal") / 80, 1).alias("current_score"),
            F.expr("timestamp'1999-06-01' + make_dt_interval(cast(c_custkey % 60 as int))").alias("last_seen"))

    # --------------------------------------------------------------------- html
    @cached_property
    def bodies(self) -> DataFrame:
        """Pages as course content; each gets one of eight fragments so that every rule meets a case."""
        extra = F.element_at(F.array(*[F.lit(x) for x in FRAGMENTS]), (F.col("page_id") % 8 + 1).cast("int"))
        return self.pages.select("page_id", (F.col("page_id") % 20).cast("string").alias("course_id"), "url",
                                 F.concat("html", extra).alias("html"))

    # ----------------------------------------------------- courses, work, people
    @cached_property
    def courses(self) -> DataFrame:
        """Suppliers as courses with registrar-style names."""
        k, t = F.col("s_suppkey"), s("s_suppkey")
        pick = lambda n, *xs: F.element_at(F.array(*xs), (k % n + 1).cast("int"))
        return self.supplier.select(
            t.alias("course_id"),
            pick(5, F.concat(F.lit("202630 MAT 1313 002 College Algebra "), t, F.lit(" (Online)")), F.concat(F.lit("IMT 2114 360 3D Engine "), t),
                 F.concat(F.lit("HC eSports "), t), F.concat(F.lit("202510 ENG 1123 FOB World Lit "), t), F.concat(F.lit("Sandbox "), t)).alias("name"),
            pick(3, F.lit(""), F.concat(F.lit("bio-"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0")), F.lit("Studio")).alias("course_code"),
            pick(4, F.lit("Default Term"), F.lit("Fall 2026 (East)"), F.lit("Lab year"), F.lit("term 202520")).alias("term_name"))

    @cached_property
    def assignments(self) -> DataFrame:
        """Parts as dated work in 97 courses; the title pattern follows the part key."""
        k = F.col("p_partkey")
        title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), (k % 10 + 1).cast("int"))
        return self.part.select(
            (k % 97).cast("string").alias("course_id"), k.cast("string").alias("assignment_id"), title.alias("name"),
            F.when(F.col("p_size") % 7 != 0, F.expr("timestamp'2026-09-01 04:59:00' + make_dt_interval(cast(p_partkey % 120 as int))")).alias("due_at"),
            F.when(k % 10 == 8, F.array(F.lit("discussion_topic"))).otherwise(F.array(F.lit("online_upload"))).alias("submission_types"),
            (k % 50 == 7).alias("is_quiz"), F.col("p_size").alias("needs_grading"))

    @cached_property
    def members(self) -> DataFrame:
        """Enrolments with sections: a course and its students."""
        courses = self.part.select(course_of().alias("course_id"), block_of().alias("_n")).distinct()
        rows = courses.join(self._people, "_n").select("course_id", "user_id")
        return rows.withColumn("section_ids", F.array((F.col("user_id").cast("int") % 3).cast("string")))

    @cached_property
    def targets(self) -> DataFrame:
        """Assignments with due and lock dates around a clock change, in two zones."""
        due = F.expr("timestamp'2026-10-25 04:59:00' + make_dt_interval(p_size % 14)")
        return self.part.select(
            course_of().alias("course_id"), s("p_partkey").alias("assignment_id"), F.when(F.col("p_size") != 50, due).alias("due_at"),
            F.when(F.col("p_size") % 2 == 1, F.expr("timestamp'2026-10-25 04:59:00' + make_dt_interval(p_size % 14 + p_size % 3)")).alias("lock_at"),
            F.when(F.col("p_type") == "PROMO", "UTC").otherwise("America/Chicago").alias("time_zone"))

    @cached_property
    def overrides(self) -> DataFrame:
        """Odd line items as overrides for named students (at times a classmate too), even ones for a section."""
        first, other = seat().cast("string"), seat(7).cast("string")
        ids = F.when(F.col("l_discount") > 0.05, F.array(first, other)).otherwise(F.array(first))
        due = F.expr("timestamp'2026-11-10 05:59:00' + make_dt_interval(cast(l_quantity as int))")
        return self.lineitem.select(
            s("l_partkey").alias("assignment_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("override_id"), F.lit("Extra days").alias("title"),
            F.when(F.col("l_linenumber") % 2 == 1, ids).alias("student_ids"),
            F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") % 3).cast("string")).alias("section_id"),
            F.when(F.col("l_tax") > 0, due).alias("due_at"), F.lit(None).cast("timestamp").alias("lock_at"))

    @cached_property
    def quizzes(self) -> DataFrame:
        return self.part.select(
            course_of().alias("course_id"), s("p_partkey").alias("quiz_id"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("time_limit"))

    @cached_property
    def grants(self) -> DataFrame:
        k = F.col("s_suppkey").cast("int")
        return self.supplier.where("s_acctbal > 4000").select(
            s("s_suppkey").alias("user_id"), F.when(k % 3 == 0, "minutes").otherwise("percent").alias("kind"), F.lit(50).alias("percent"),
            (k % 30).alias("minutes"), F.when(k % 8 == 0, 1).otherwise(0).alias("extra_attempts"), (k % 14 == 0).alias("manually_unlocked"))

    # ------------------------------------------------------------ merges, quizzes
    def _side(self, odd: int) -> DataFrame:
        """The latest line per (part, supplier) among odd or even orders: one machine's copy."""
        last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).alias("x")
        return self.lineitem.where(F.col("l_orderkey") % 2 == odd).groupBy("l_partkey", "l_suppkey").agg(last).select(
            s("l_partkey").alias("assignment_id"), s("l_suppkey").alias("user_id"), (F.floor(F.col("x.l_quantity") / 10) * 10).cast("double").alias("score"),
            F.col("x.l_linenumber").alias("n"), F.col("x.l_returnflag").alias("flag"), F.col("x.l_shipdate").alias("updated"))

    @cached_property
    def local_grades(self) -> DataFrame:
        return self._side(1).select(
            "assignment_id", "user_id", F.col("score").alias("total"),
            F.when(F.col("flag") == "N", "no-submission").when(F.col("flag") == "A", "ai").otherwise("human").alias("source"),
            F.when(F.col("n") % 3 == 1, F.col("score")).when(F.col("n") % 3 == 2, F.col("score") + 10).alias("synced_score"),
            (F.col("n") == 5).alias("in_conflict"), "updated")

    @cached_property
    def remote_grades(self) -> DataFrame:
        return self._side(0).select(
            "assignment_id", "user_id", F.when(F.col("n") != 7, F.col("score")).alias("score"),
            F.when(F.col("flag") == "R", "unsubmitted").otherwise("submitted").alias("status"), (F.col("n") == 6).alias("needs_written"),
            F.when(F.col("n") % 2 == 0, F.col("updated")).alias("posted_at"), "updated")

    @cached_property
    def bank(self) -> DataFrame:
        """Parts as quiz questions, five to a quiz."""
        kind = F.create_map(*[F.lit(x) for kv in QUESTION_TYPES.items() for x in kv])
        ans = lambda i, t, w: F.struct(F.lit(i).alias("id"), t.alias("text"), F.lit(None).cast("string").alias("answer_text"),
                                       w.cast("double").alias("weight"), F.lit(None).cast("double").alias("answer_weight"), F.lit(None).cast("boolean").alias("correct"))
        size = F.col("p_size")
        three = F.array(ans("a", F.col("p_name"), F.when(size % 11 == 0, 0).otherwise(100)), ans("b", F.when(size % 9 == 0, " ").otherwise("<i>other</i>"), F.when(size % 10 == 0, 100).otherwise(0)),
                        ans("c", F.lit("third"), F.lit(0)))
        return self.part.select(
            F.floor(F.col("p_partkey") / 5).cast("string").alias("quiz_id"), s("p_partkey").alias("question_id"), F.col("p_partkey").alias("position"),
            kind[F.col("p_type")].alias("question_type"), F.col("p_name").alias("name"), size.cast("double").alias("points_possible"),
            F.when(F.col("p_type") == "ECONOMY", F.slice(three, 1, 0)).when((F.col("p_type") == "SMALL") & (size % 6 != 0), F.slice(three, 1, 2)).otherwise(three).alias("answers"))

    @cached_property
    def quiz_answers(self) -> DataFrame:
        """Line items as answers: order is the student, part the question; the last line counts."""
        last = F.max(F.struct("l_shipdate", "l_linenumber", "l_quantity", "l_returnflag")).alias("x")
        # dealt by student and quiz, so that what is grouped or joined by these needs no further shuffle
        lines = self.lineitem.withColumn("quiz_id", F.floor(F.col("l_partkey") / 5).cast("string")).repartition("l_orderkey", "quiz_id")
        return lines.groupBy("l_orderkey", "quiz_id", "l_partkey").agg(last).select(
            F.col("l_orderkey").alias("user_id"), "quiz_id", s("l_partkey").alias("question_id"),
            F.when(F.col("x.l_returnflag") == "A", "a").when(F.col("x.l_returnflag") == "R", "b").alias("answer_id"),
            F.when(F.col("x.l_linenumber") > 2, F.concat(F.lit("<p>essay "), F.col("x.l_linenumber").cast("string"), F.lit("</p>"))).alias("text"),
            F.col("x.l_quantity").alias("points"), (F.col("x.l_returnflag") == "A").alias("correct"))


def block_of():
    """The block of assignments a part is in: 400, whose 25 brands are courses of the same 20 students."""
    return F.expr("p_partkey div 400")


def course_of():
    return F.concat_ws("-", "p_brand", block_of())


def seat(step: int = 0):
    """The student of the part's block who stands for a line item's supplier, or one ``step`` seats on."""
    return F.expr(f"(l_partkey div 400) * 20 + (l_suppkey + {step}) % 20")


def event_course():
    """Course of an event: the tens digit of its property ``k``."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return F.floor(k / 10).cast("string").alias("course_id")


TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages "
                   "benchmark labels conversations".split())

# Fixed values of the feed: the rubric every assignment gets.
RUBRIC = (("c1", "Depth of Work", 50.0), ("c2", "Use of Sources", 10.0), ("c3", "Form & Style", 8.0))

FEED_SQL["rubric"] = """
SELECT p_brand AS course_id, CAST(p_partkey AS VARCHAR) AS assignment_id, c.criterion_id, c.label, c.points
FROM part, (VALUES ('c1','Depth of Work',50.0::DOUBLE), ('c2','Use of Sources',10.0::DOUBLE),
                   ('c3','Form & Style',8.0::DOUBLE)) c(criterion_id, label, points)"""
FEED_SQL["grades"] = """
SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, l_orderkey || '-' || l_linenumber AS user_id,
 CASE WHEN l_returnflag='N' THEN 'no-submission' WHEN l_linestatus='F' THEN 'ai' ELSE 'lms' END AS source,
 round(l_quantity,2) AS c1, round(l_discount*100,2) AS c2, round(l_tax*100,2) AS c3,
 round(l_quantity+l_discount*100+l_tax*100,2) AS total, l_linenumber = 5 AS total_only,
 CASE WHEN l_linenumber=7 THEN 5.0 ELSE 0.0 END::DOUBLE AS curve_flat,
 CASE WHEN l_linenumber=6 THEN 3.0 ELSE 0.0 END::DOUBLE AS curve_c1,
 list_filter([CASE WHEN l_quantity<5 THEN 'very short' END, CASE WHEN l_discount>0.08::DOUBLE THEN 'sources unclear' END,
   CASE WHEN l_linestatus='O' THEN 'check by hand' END], lambda x: x IS NOT NULL) AS flags
FROM lineitem"""
FEED_SQL["final"] = """
SELECT *, CASE WHEN total_only THEN total ELSE round(c1+c2+c3,2) END AS earned,
 round(least(68.0, greatest(0.0, CASE WHEN total_only THEN total
   ELSE least(c1+curve_c1,50.0)+least(c2,10.0)+least(c3,8.0) END + curve_flat)),2) AS shown,
 source <> 'no-submission' AS scored FROM grades"""
FEED_SQL["syllabi"] = """
SELECT CAST(p_partkey AS VARCHAR) AS assignment_id, p_brand AS course_id,
 CASE WHEN p_type='ECONOMY' THEN 'Late work will lose ' || p_size || '% per day, up to 7 days.' || chr(10) || 'Minimum score of 40 percent.'
  WHEN p_type='PROMO' THEN 'Late submissions: ' || p_size || ' percent each hour,  with a 12 hour grace period.'
  WHEN p_type='MEDIUM' THEN 'No late work. Plan ahead.' WHEN p_type='SMALL' THEN 'Anything late earns half credit.'
  WHEN p_type='LARGE' THEN 'Late work is accepted without penalty in this course.'
  WHEN p_size % 2 = 0 THEN 'If late, expect a ' || p_size || '% penalty.' ELSE 'Projects are due on Friday.' END AS body FROM part"""
FEED_SQL["policies"] = """
SELECT assignment_id, course_id,
 CASE WHEN body LIKE 'Late work will lose%' THEN 'percent_per_day' WHEN body LIKE '%each hour%' THEN 'percent_per_hour'
  WHEN body LIKE 'No late%' THEN 'none_accepted' WHEN body LIKE '%half credit%' OR body LIKE 'If late%' THEN 'flat_percent'
  WHEN body LIKE '%without penalty%' THEN 'no_penalty' ELSE 'none' END AS kind,
 CASE WHEN body LIKE '%half credit%' THEN 50.0 ELSE coalesce(TRY_CAST(regexp_extract(
   CASE WHEN body LIKE 'Late work is%' THEN '' ELSE body END, '([0-9]+) *(%|percent)', 1) AS DOUBLE), 0.0) END AS percent,
 CASE WHEN body LIKE '%each hour%' THEN 'hour' ELSE 'day' END AS interval,
 CASE WHEN body LIKE '%grace%' THEN 12.0 ELSE 0.0 END AS grace_hours,
 CASE WHEN body LIKE '%Minimum score%' THEN 40.0 ELSE 0.0 END AS floor_percent,
 CASE WHEN body LIKE '%up to 7 days%' THEN 7 END AS max_days FROM syllabi"""
FEED_SQL["late_rows"] = """
SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, l_orderkey || '-' || l_linenumber AS user_id,
 date_diff('second', o_orderdate, l_shipdate) > 0 AS late, date_diff('second', o_orderdate, l_shipdate) AS seconds_late,
 l_quantity AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
COURSE, SEAT = "p_brand || '-' || p_partkey // 400", "l_partkey // 400 * 20 + l_suppkey % 20"
FEED_SQL["enrolled"] = f"""
SELECT {COURSE} AS course_id, CAST(p_partkey AS VARCHAR) AS assignment_id, CAST(s_suppkey AS VARCHAR) AS user_id, s_name AS name
FROM part JOIN supplier ON p_partkey // 400 = s_suppkey // 20"""
FEED_SQL["submissions"] = f"""
SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, CAST(seat AS VARCHAR) AS user_id,
 CASE WHEN x.f <> 'R' THEN x.d END AS submitted_at, x.n = 7 AS excused, x.q AS score,
 CASE x.f WHEN 'R' THEN 'unsubmitted' WHEN 'N' THEN 'graded' ELSE 'submitted' END AS status,
 CAST(attempt AS INT) AS attempt, x.n AS words
FROM (SELECT l_partkey, {SEAT} AS seat, count(*) AS attempt, max({{'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber,
  'q': l_quantity, 'f': l_returnflag}}) AS x FROM lineitem GROUP BY ALL)"""

EVENT_COURSE = "CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) // 10 AS VARCHAR)"
FEED_SQL["marks"] = f"""
SELECT course_id, day, user_id, status, CASE WHEN status='tardy' THEN CAST(least(floor(x.v),180) AS INT) ELSE 0 END AS minutes,
 '' AS note, x.ts AS updated FROM (SELECT course_id, day, user_id, x, CASE x.t WHEN 'click' THEN 'present' WHEN 'view' THEN 'tardy'
  WHEN 'error' THEN 'absent' WHEN 'signup' THEN 'excused' ELSE '' END AS status
 FROM (SELECT {EVENT_COURSE} AS course_id, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS user_id,
   max({{'ts': ts, 'id': event_id, 't': event_type, 'v': value}}) AS x FROM events GROUP BY ALL))"""
FEED_SQL["roster"] = f"SELECT DISTINCT {EVENT_COURSE} AS course_id, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type='signup'"
FEED_SQL["patterns"] = f"""
SELECT course_id, CASE WHEN n=9 THEN []::VARCHAR[] WHEN n%2=0 THEN ['mon','wed'] ELSE ['tue','thu'] END AS weekdays,
 DATE '2024-01-01' + n AS start_day, DATE '2024-01-26' AS end_day, n%3<>0 AS skip_breaks
FROM (SELECT DISTINCT {EVENT_COURSE} AS course_id, CAST({EVENT_COURSE} AS INT) AS n FROM events)"""
FEED_SQL["meet_overrides"] = f"""
SELECT course_id, day, x.on_day FROM (SELECT {EVENT_COURSE} AS course_id, CAST(ts AS DATE) AS day,
 max({{'ts': ts, 'id': event_id, 'on_day': event_id%2=0}}) AS x FROM events WHERE event_type='purchase' AND value<0.5
 AND props <> '{{"k": 90}}' GROUP BY ALL) WHERE course_id <> '9'"""
FEED_SQL["meetings"] = """
SELECT course_id, day FROM (
 SELECT course_id, CAST(d AS DATE) AS day FROM (SELECT *, unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS d FROM patterns)
 WHERE list_contains(weekdays, lower(strftime(d, '%a'))) AND NOT (skip_breaks AND CAST(d AS DATE) IN (DATE '2024-01-15', DATE '2024-01-16'))
  AND (course_id, CAST(d AS DATE)) NOT IN (SELECT (course_id, day) FROM meet_overrides WHERE NOT on_day)
 UNION SELECT course_id, day FROM meet_overrides WHERE on_day)"""
FEED_SQL["totals"] = """
SELECT course_id, user_id, count(*) FILTER (WHERE status='present' AND m) AS present, count(*) FILTER (WHERE status='tardy' AND m) AS tardy,
 count(*) FILTER (WHERE status='absent' AND m) AS absent, count(*) FILTER (WHERE status='excused' AND m) AS excused,
 CAST(coalesce(sum(minutes) FILTER (WHERE status='tardy' AND m),0) AS BIGINT) AS minutes
FROM (SELECT * FROM roster UNION SELECT course_id, user_id FROM marks) LEFT JOIN
 (SELECT marks.*, meetings.day IS NOT NULL AS m FROM marks LEFT JOIN meetings USING (course_id, day)) USING (course_id, user_id) GROUP BY ALL"""
FEED_SQL["work"] = """
SELECT *, course_id || '-' || year(o_orderdate) AS assignment_id FROM
 (SELECT *, CAST(o_custkey // 25 * 2 + CASE WHEN o_orderpriority[1] < '3' THEN 0 ELSE 1 END AS VARCHAR) AS course_id FROM orders)"""
FEED_SQL["due_items"] = """
SELECT DISTINCT course_id, assignment_id, make_timestamp(year(o_orderdate), 12, 1, 0, 0, 0.0) AS due_at,
 (CAST(course_id AS INT) + year(o_orderdate)*3) % 13 <> 0 AS published FROM work"""
FEED_SQL["coursework"] = """
SELECT course_id, user_id, assignment_id, CASE x.s WHEN 'F' THEN 'graded' WHEN 'O' THEN 'submitted' ELSE 'unsubmitted' END AS workflow_state,
 CASE WHEN x.s<>'P' THEN x.d + to_days(CAST(x.k%5 AS INT)) END AS submitted_at, x.k%17=0 AS missing, x.k%11=0 AS excused, CASE WHEN x.k%7=0 THEN 0.0 ELSE x.p END AS score
FROM (SELECT course_id, assignment_id, CAST(o_custkey AS VARCHAR) AS user_id, max({'d': o_orderdate, 'k': o_orderkey, 's': o_orderstatus, 'p': o_totalprice}) AS x FROM work GROUP BY ALL)"""
FEED_SQL["enrollment"] = """
SELECT CAST(unnest([c_custkey//25*2, c_custkey//25*2+1]) AS VARCHAR) AS course_id, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, round(c_acctbal/80,1) AS g,
 TIMESTAMP '1999-06-01' + to_days(CAST(c_custkey%60 AS INT)) AS last_seen FROM customer"""
FEED_SQL["stats"] = """
SELECT course_id, user_id, any_value(name) AS name, any_value(CASE WHEN g<=100 THEN g END) AS grade,
 list_sort(list_distinct(coalesce(list(assignment_id) FILTER (WHERE absent), []))) AS missing_ids,
 list_sort(list_distinct(coalesce(list(assignment_id) FILTER (WHERE zero), []))) AS zero_ids,
 max(submitted_at) AS last_submit, any_value(last_seen) AS last_activity_at
FROM (SELECT *, NOT coalesce(excused, false) AND nothing AS absent, NOT coalesce(excused, false) AND NOT nothing AND score=0 AS zero FROM
  (SELECT *, coalesce(missing, false) OR (submitted_at IS NULL AND coalesce(workflow_state, 'unsubmitted')='unsubmitted') AS nothing
   FROM due_items JOIN enrollment USING (course_id) LEFT JOIN coursework USING (course_id, assignment_id, user_id)
   WHERE published AND due_at <= TIMESTAMP '1999-07-01')) GROUP BY course_id, user_id"""
FEED_SQL["risk"] = """
SELECT *, least(100, p0+least(40,missing*10)+least(20,zeros*5)+CASE WHEN missing>0 AND ds>=14 THEN 12 ELSE 0 END+CASE WHEN da>=14 THEN 8 ELSE 0 END) AS score,
 list_filter([CASE WHEN grade<80 THEN 'grade ' || CAST(round_even(grade,0) AS BIGINT) || '%' END,
  CASE WHEN missing>0 THEN missing || CASE WHEN missing=1 THEN ' past-due item not turned in' ELSE ' past-due items not turned in' END END,
  CASE WHEN zeros>0 THEN zeros || CASE WHEN zeros=1 THEN ' zero' ELSE ' zeros' END END,
  CASE WHEN missing>0 AND ds>=14 THEN 'no submission in ' || ds || ' days' END,
  CASE WHEN da>=14 THEN 'no platform activity in ' || da || ' days' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, len(missing_ids) AS missing, len(zero_ids) AS zeros, CASE WHEN grade<60 THEN 35 WHEN grade<70 THEN 20 WHEN grade<80 THEN 8 ELSE 0 END AS p0,
 greatest(0, date_diff('second', last_submit, TIMESTAMP '1999-07-01')//86400) AS ds,
 greatest(0, date_diff('second', last_activity_at, TIMESTAMP '1999-07-01')//86400) AS da FROM stats)"""

# Fixed values of the feed: markup appended to pages, chosen by page_id % 8.
FRAGMENTS = (
    "", '<img src="/files/12/a.png"><img src="b.png" alt="photo.jpg">', "<table><tr><th>A</th><td>1</td></tr></table>",
    '<h4>Part</h4><a href="x"></a>',
    "<h2>Top</h2><h3>Sub</h3><p><strong>You Do It 1</strong></p><p><b>This sentence is bold for no good reason at all.</b></p>",
    '<ul><li>a<ul><li>b</li></ul></li></ul><p style="color:#777777;background:#888888">dim &#233;&nbsp;text</p>',
    '<a href="https://files.example.com/courses/1/files/77/download">f</a><img src="/courses/1/files/78" alt="a chart of results">'
    '<a href="https://evil.example/files/9">x</a>',
    '<span style="border: 1px solid #d7dce3;">boxed</span><p onclick="go()">hi</p><iframe src="https://v.example.com/1"></iframe>')
FEED_SQL["bodies"] = f"""
SELECT page_id, CAST(page_id % 20 AS VARCHAR) AS course_id, url,
 html || [{", ".join("'" + f + "'" for f in FRAGMENTS)}][page_id % 8 + 1] AS html FROM pages"""
FEED_SQL["texts"] = r"""
SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t0, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
 '&#233;', 'é'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')) AS vis
FROM (SELECT *, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t0
 FROM bodies)"""

# Fixed values of the feed: titles of dated work, chosen by part key % 10.
TITLES = ("Final Exam", "Week 3 Quiz", "Practice Test", "Practice 5 - Trigger Test Bench", "Schedule Proctored Final Exam",
          "Midterm", "Chapter Exam (proctored)", "Essay", "Talk it over", "Unit test 2")
FEED_SQL["courses"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS course_id,
 CASE s_suppkey%5 WHEN 0 THEN '202630 MAT 1313 002 College Algebra ' || s_suppkey || ' (Online)' WHEN 1 THEN 'IMT 2114 360 3D Engine ' || s_suppkey
  WHEN 2 THEN 'HC eSports ' || s_suppkey WHEN 3 THEN '202510 ENG 1123 FOB World Lit ' || s_suppkey ELSE 'Sandbox ' || s_suppkey END AS name,
 CASE s_suppkey%3 WHEN 0 THEN '' WHEN 1 THEN 'bio-' || (s_suppkey%9000+1000) ELSE 'Studio' END AS course_code,
 CASE s_suppkey%4 WHEN 0 THEN 'Default Term' WHEN 1 THEN 'Fall 2026 (East)' WHEN 2 THEN 'Lab year' ELSE 'term 202520' END AS term_name FROM supplier"""
FEED_SQL["course_terms"] = """
SELECT *, coalesce(CASE substr(code,5,2) WHEN '10' THEN 'Spring' WHEN '20' THEN 'Summer' WHEN '30' THEN 'Fall' END || ' ' || substr(code,1,4),
  CASE WHEN term_name='Lab year' THEN 'Lab year' ELSE 'Sandboxes and other' END) AS label, coalesce(CAST(code AS INT), -1) AS sort
FROM (SELECT *, coalesce(nullif(regexp_extract(name, '(20[0-9]{4})', 1), ''), CASE term_name WHEN 'Fall 2026 (East)' THEN '202630' WHEN 'term 202520' THEN '202520' END) AS code FROM courses)"""
FEED_SQL["course_names"] = """
SELECT course_id, CASE WHEN course_code LIKE 'bio%' THEN 'BIO ' || substr(course_code, 5) WHEN name LIKE '%MAT 1313%' THEN 'MAT 1313' WHEN name LIKE 'IMT%' THEN 'IMT 2114'
  WHEN name LIKE '%ENG 1123%' THEN 'ENG 1123' WHEN course_code <> '' THEN course_code ELSE substr(name, 1, 14) END AS code,
 CASE WHEN name LIKE '2026%' THEN 'College Algebra ' || course_id WHEN name LIKE 'IMT%' THEN '3D Engine ' || course_id
  WHEN name LIKE '2025%' THEN 'World Lit ' || course_id ELSE name END AS label FROM courses"""
FEED_SQL["assignments"] = f"""
SELECT CAST(p_partkey%97 AS VARCHAR) AS course_id, CAST(p_partkey AS VARCHAR) AS assignment_id, {list(TITLES)!r}[p_partkey%10+1] AS name,
 CASE WHEN p_size%7<>0 THEN TIMESTAMP '2026-09-01 04:59:00' + to_days(CAST(p_partkey%120 AS INT)) END AS due_at,
 CASE WHEN p_partkey%10=7 THEN CASE WHEN p_partkey%50=7 THEN 'quiz' ELSE 'assignment' END
  ELSE ['final','quiz','practice','assignment','assignment','test','exam','','discussion','test'][p_partkey%10+1] END AS kind,
 p_partkey%10 IN (0,5,6,9) AS exam, p_partkey%10 IN (4,6) AS proctored, p_size AS needs_grading FROM part"""
FEED_SQL["items"] = """
SELECT course_id, assignment_id, name, due_at, needs_grading, kind, exam, proctored, code, label
FROM assignments JOIN course_names USING (course_id) WHERE due_at IS NOT NULL"""
FEED_SQL["targets"] = f"""
SELECT {COURSE} AS course_id, CAST(p_partkey AS VARCHAR) AS assignment_id, CASE WHEN p_size<>50 THEN TIMESTAMP '2026-10-25 04:59:00' + to_days(p_size%14) END AS due_at,
 CASE WHEN p_size%2=1 THEN TIMESTAMP '2026-10-25 04:59:00' + to_days(p_size%14 + p_size%3) END AS lock_at,
 CASE WHEN p_type='PROMO' THEN 'UTC' ELSE 'America/Chicago' END AS time_zone FROM part"""
FEED_SQL["overrides"] = f"""
SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS override_id,
 CASE WHEN l_linenumber%2=1 THEN CASE WHEN l_discount>0.05::DOUBLE THEN [CAST({SEAT} AS VARCHAR), CAST(l_partkey // 400 * 20 + (l_suppkey+7) % 20 AS VARCHAR)]
  ELSE [CAST({SEAT} AS VARCHAR)] END END AS student_ids,
 CASE WHEN l_linenumber%2=0 THEN CAST(l_suppkey%3 AS VARCHAR) END AS section_id,
 CASE WHEN l_tax>0 THEN TIMESTAMP '2026-11-10 05:59:00' + to_days(CAST(l_quantity AS INT)) END AS due_at FROM lineitem"""
FEED_SQL["effective"] = """
SELECT e.course_id, e.assignment_id, e.user_id, t.time_zone, coalesce(b.o.how, 'everyone') AS how, CASE WHEN b.o IS NULL THEN t.due_at ELSE b.o.due END AS due_at,
 t.lock_at, CASE WHEN b.o.how='adhoc' THEN b.o.id END AS override_id, coalesce(b.o.shared, 0) AS shared_with
FROM enrolled e JOIN targets t USING (course_id, assignment_id) LEFT JOIN
 (SELECT assignment_id, user_id, max({'open': due_at IS NULL, 'due': due_at, 'id': override_id, 'how': how, 'shared': shared}) AS o FROM
  (SELECT assignment_id, override_id, due_at, 'adhoc' AS how, len(student_ids)-1 AS shared, unnest(student_ids) AS user_id FROM overrides WHERE student_ids IS NOT NULL
   UNION ALL SELECT o.assignment_id, o.override_id, o.due_at, 'section', 0, m.user_id FROM overrides o JOIN enrolled m USING (assignment_id)
   WHERE o.section_id = CAST(CAST(m.user_id AS INT)%3 AS VARCHAR)) GROUP BY ALL) b USING (assignment_id, user_id)"""
FEED_SQL["quizzes"] = f"""
SELECT {COURSE} AS course_id, CAST(p_partkey AS VARCHAR) AS quiz_id, CASE WHEN p_size>10 THEN p_size END AS time_limit FROM part"""
FEED_SQL["grants"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS user_id, CASE WHEN s_suppkey%3=0 THEN 'minutes' ELSE 'percent' END AS kind, 50 AS percent, CAST(s_suppkey%30 AS INT) AS minutes,
 CASE WHEN s_suppkey%8=0 THEN 1 ELSE 0 END AS extra_attempts, s_suppkey%14=0 AS manually_unlocked FROM supplier WHERE s_acctbal > 4000"""

# Fixed values of the feed: question type by part type.
QUESTION_TYPES = {"ECONOMY": "essay_question", "PROMO": "file_upload_question", "SMALL": "true_false_question", "LARGE": "hologram_question",
                  "MEDIUM": "multiple_choice_question", "STANDARD": "multiple_answers_question"}
FEED_SQL["side"] = """
SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, CAST(l_suppkey AS VARCHAR) AS user_id, floor(x.q/10)*10 AS score, x.n AS n, x.f AS flag, x.d AS updated, odd FROM
 (SELECT l_partkey, l_suppkey, l_orderkey%2 AS odd, max({'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 'q': l_quantity, 'f': l_returnflag}) AS x FROM lineitem GROUP BY ALL)"""
FEED_SQL["local_grades"] = """
SELECT assignment_id, user_id, score AS total, CASE flag WHEN 'N' THEN 'no-submission' WHEN 'A' THEN 'ai' ELSE 'human' END AS source,
 CASE n%3 WHEN 1 THEN score WHEN 2 THEN score+10 END AS synced_score, n=5 AS in_conflict, updated FROM side WHERE odd=1"""
FEED_SQL["remote_grades"] = """
SELECT assignment_id, user_id, CASE WHEN n<>7 THEN score END AS score, CASE WHEN flag='R' THEN 'unsubmitted' ELSE 'submitted' END AS status, n=6 AS needs_written,
 CASE WHEN n%2=0 THEN updated END AS posted_at, updated FROM side WHERE odd=0"""
FEED_SQL["merged"] = """
SELECT assignment_id, user_id, outcome, CASE WHEN outcome='adopted' THEN score ELSE total END AS total, CASE WHEN outcome='adopted' THEN 'lms' ELSE source END AS source,
 CASE WHEN outcome IN ('adopted','in_sync') THEN score ELSE synced_score END AS synced_score, CASE WHEN outcome='conflict' THEN score END AS remote_score FROM
 (SELECT *, CASE WHEN r IS NULL OR (score IS NULL AND NOT coalesce(in_conflict,false)) THEN 'untouched' WHEN score IS NULL THEN 'cleared'
   WHEN ph AND status='unsubmitted' THEN 'unsubmitted' WHEN ph AND needs_written THEN 'quiz_open' WHEN ph THEN 'adopted' WHEN total=score THEN 'in_sync'
   WHEN synced_score IS NOT NULL AND total=synced_score AND score<>synced_score THEN 'adopted' WHEN synced_score IS NOT NULL AND total<>synced_score AND score=synced_score THEN 'kept' ELSE 'conflict' END AS outcome
  FROM (SELECT *, l IS NULL OR source='no-submission' AS ph FROM (SELECT *, 1 AS l FROM local_grades) FULL JOIN (SELECT *, 1 AS r FROM remote_grades) USING (assignment_id, user_id)))"""
FEED_SQL["bank"] = """
SELECT CAST(p_partkey//5 AS VARCHAR) AS quiz_id, CAST(p_partkey AS VARCHAR) AS question_id, p_partkey AS position, p_name, p_size, p_type,
 CASE p_type WHEN 'ECONOMY' THEN 'essay_question' WHEN 'PROMO' THEN 'file_upload_question' WHEN 'SMALL' THEN 'true_false_question' WHEN 'LARGE' THEN 'hologram_question'
  WHEN 'MEDIUM' THEN 'multiple_choice_question' ELSE 'multiple_answers_question' END AS question_type,
 CASE WHEN p_type='ECONOMY' THEN 0 WHEN p_type='SMALL' AND p_size%6<>0 THEN 2 ELSE 3 END AS n,
 CASE WHEN p_size%11=0 THEN 0 ELSE 1 END + CASE WHEN p_size%10=0 THEN 1 ELSE 0 END AS good FROM part"""
FEED_SQL["quiz_answers"] = """
SELECT l_orderkey AS user_id, CAST(l_partkey//5 AS VARCHAR) AS quiz_id, CAST(l_partkey AS VARCHAR) AS question_id, CASE x.f WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' END AS answer_id,
 CASE WHEN x.n>2 THEN 'essay ' || x.n END AS text, x.q AS points, x.f='A' AS correct
FROM (SELECT l_orderkey, l_partkey, max({'d': l_shipdate, 'n': l_linenumber, 'q': l_quantity, 'f': l_returnflag}) AS x FROM lineitem GROUP BY ALL)"""
