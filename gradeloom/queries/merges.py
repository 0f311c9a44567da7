"""Merge and quiz queries: odd and even orders are two machines; parts are questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import merges, quizzes
from gradeloom.queries.feed import event_course
from gradeloom.queries.registry import query

AU = ["assignment_id", "user_id"]
GR = "side local_grades remote_grades"


def c(n):
    return F.col(n)


def merged(feed):
    return merges.three_way_merge(feed.local_grades, feed.remote_grades, AU)


@query("three_way_merge", "SELECT * FROM merged", f"{GR} merged")
def three_way_merge(feed):
    return merged(feed).withColumn("remote_score", c("conflict.remote_score")).drop("conflict")


@query("adopted_cells", """SELECT assignment_id, user_id, outcome, CASE WHEN outcome='adopted' THEN CASE WHEN k=0 OR k=1 AND total=0 THEN round(total*0.5,2) END ELSE lt END AS c1,
 CASE WHEN outcome='adopted' AND k=0 THEN total - round(total*0.5,2) END AS c2, CASE WHEN outcome='adopted' THEN NOT (k=0 OR k=1 AND total=0) ELSE lo END AS total_only
 FROM (SELECT m.*, CAST(m.user_id AS INT)%3 AS k, l.total AS lt, l.in_conflict AS lo FROM merged m LEFT JOIN local_grades l USING (assignment_id, user_id))""", f"{GR} merged")
def adopted_cells(feed):
    """Adopted grades with the gradebook's cells where they add up; a cell outside the rubric or no cells leave the total alone."""
    k, half = c("user_id").cast("int") % 3, F.round(c("score") * 0.5, 2)
    cells = F.when(k == 0, F.create_map(F.lit("c1"), half, F.lit("c2"), c("score") - half)).when(
        k == 1, F.create_map(F.lit("c1"), half, F.lit("zz"), c("score") - half + 1.0))
    remote = feed.remote_grades.withColumn("cells", cells).withColumn("criteria", F.array(F.lit("c1"), F.lit("c2")))
    local = feed.local_grades.withColumn("scores", F.create_map(F.lit("c1"), "total")).withColumn("total_only", c("in_conflict"))
    rows = merges.three_way_merge(local, remote, AU)
    return rows.select(*AU, "outcome", F.try_element_at("scores", F.lit("c1")).alias("c1"), F.try_element_at("scores", F.lit("c2")).alias("c2"), "total_only")


@query("resolve_conflicts", """SELECT assignment_id, user_id, CASE WHEN remote_score IS NOT NULL AND ch='theirs' THEN remote_score ELSE total END AS total,
 CASE WHEN remote_score IS NOT NULL AND ch='theirs' THEN 'lms' ELSE source END AS source, CASE WHEN remote_score IS NOT NULL AND ch IS NOT NULL THEN remote_score ELSE synced_score END AS synced_score,
 remote_score IS NOT NULL AND ch IS NOT NULL AS settled, remote_score IS NOT NULL AND ch IS NULL AS open
 FROM (SELECT *, CASE CAST(user_id AS INT)%3 WHEN 0 THEN 'theirs' WHEN 1 THEN 'mine' END AS ch FROM merged)""", f"{GR} merged")
def resolve_conflicts(feed):
    rows = merged(feed)
    pick = F.when(c("user_id").cast("int") % 3 == 0, "theirs").otherwise("mine")
    choices = rows.where("cast(user_id as int) % 3 <> 2").select(*AU, pick.alias("choice"))
    return merges.resolve_conflicts(rows, choices, AU)


def books(feed, side):
    rows = feed.events.where(c("event_id") % 2 == side).select(event_course(), F.to_date("ts").alias("day"), c("user_id").cast("string").alias("user_id"), "ts", "event_id", "event_type")
    return rows.groupBy("course_id", "day", "user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select(
        "course_id", "day", "user_id", c("x.event_type").alias("status"), F.date_trunc("hour", "x.ts").alias("updated"))


BOOK = """SELECT CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) // 10 AS VARCHAR) AS course_id, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS user_id,
 max({'ts': ts, 'id': event_id, 't': event_type}) AS x FROM events WHERE event_id%2=%d GROUP BY ALL"""


@query("lww_merge", f"""SELECT course_id, day, user_id, CASE WHEN s='left' THEN ax.t ELSE bx.t END AS status, date_trunc('hour', CASE WHEN s='left' THEN ax.ts ELSE bx.ts END) AS updated, s AS side FROM
 (SELECT course_id, day, user_id, a.x AS ax, b.x AS bx, CASE WHEN b.x IS NULL OR (a.x IS NOT NULL AND date_trunc('hour', a.x.ts) >= date_trunc('hour', b.x.ts)) THEN 'left' ELSE 'right' END AS s
  FROM ({BOOK.replace('%d', '0')}) a FULL JOIN ({BOOK.replace('%d', '1')}) b USING (course_id, day, user_id))""")
def lww_merge(feed):
    return merges.lww_merge(books(feed, 0), books(feed, 1), ["course_id", "day", "user_id"])


@query("merge_conflicts", """SELECT l.assignment_id, l.user_id, CASE WHEN r.updated>=l.updated THEN r.score ELSE l.total END AS kept, CASE WHEN r.updated>=l.updated THEN l.total ELSE r.score END AS other
 FROM local_grades l JOIN (SELECT assignment_id, user_id, coalesce(score,0) AS score, updated FROM remote_grades) r USING (assignment_id, user_id) WHERE l.total<>r.score""", GR)
def merge_conflicts(feed):
    left = feed.local_grades.select(*AU, c("total").alias("g"), "updated")
    right = feed.remote_grades.select(*AU, F.coalesce("score", F.lit(0.0)).alias("g"), "updated")
    return merges.merge_conflicts(left, right, AU, ["g"]).select(*AU, c("kept.g").alias("kept"), c("other.g").alias("other"))


HIST = """SELECT user_id, ts AS "at", event_type AS kind, course_id, aid AS assignment_id, summary FROM (SELECT user_id, ts, event_type, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) // 10 AS VARCHAR) AS course_id,
  CAST(event_id%7 AS VARCHAR) AS aid, 'value ' || value AS summary, event_id FROM events)"""


@query("history_union", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, kind, course_id, assignment_id, summary) AS place
 FROM (SELECT DISTINCT * FROM ({HIST}))) """)
def history_union(feed):
    rows = feed.events.select("user_id", c("ts").alias("at"), c("event_type").alias("kind"), event_course(), (c("event_id") % 7).cast("string").alias("assignment_id"),
                              F.concat(F.lit("value "), c("value").cast("string")).alias("summary"), "event_id")
    saved, local = rows.where("event_id % 3 < 2").drop("event_id"), rows.where("event_id % 3 > 0").drop("event_id")
    return merges.history_union(saved, local, "user_id")


@query("replica_decision", """SELECT key, CASE WHEN rv IS NULL THEN CASE WHEN h IS NULL THEN 'empty' ELSE 'push' END WHEN h IS NULL THEN 'pull' WHEN h=t THEN 'keep'
 WHEN h<>sent AND rv>sr AND t<>sent THEN 'diverged' WHEN rv>sr AND NOT coalesce(h<>sent,false) THEN 'pull' ELSE 'push' END AS action, sr AS local_rev, coalesce(rv,0) AS remote_rev FROM
 (SELECT c_custkey AS key, CASE WHEN c_custkey%5<>0 THEN c_custkey%3 END AS h, CASE WHEN c_custkey%7<>0 THEN c_custkey%4 END AS rv, c_custkey%2 AS t, CASE WHEN c_custkey%11<>0 THEN c_custkey%6//2 END AS sent,
   CASE WHEN c_custkey%11<>0 THEN c_custkey%3 ELSE 0 END AS sr FROM customer)""")
def replica_decision(feed):
    k = c("c_custkey")
    rows = feed.customer.select(k.alias("key"))
    sha = lambda n: F.sha2((n).cast("string"), 256)
    key = c("key")
    local = rows.select("key", F.when(key % 5 != 0, sha(key % 3)).alias("sha256"))
    remote = rows.where("key % 7 <> 0").select("key", (key % 4).alias("rev"), sha(key % 2).alias("sha256"))
    sent = rows.where("key % 11 <> 0").select("key", (key % 3).alias("rev"), sha(F.floor((key % 6) / 2)).alias("sha256"))
    return merges.replica_decision(local, remote, sent, "key")


@query("unsent_months", """SELECT doc_id AS name FROM documents WHERE doc_id%3<>0""")
def unsent_months(feed):
    manifest = feed.documents.select(c("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    sent = feed.documents.where("doc_id % 3 < 2").select(c("doc_id").alias("name"), F.sha2(F.when(c("doc_id") % 3 == 0, c("text")).otherwise("old"), 256).alias("sha256"))
    return merges.unsent(manifest, sent).select("name")


@query("priority_merge", """SELECT assignment_id, user_id, CASE WHEN l.source IS NULL THEN 'right' WHEN r.score IS NULL AND r.updated IS NULL THEN 'left' WHEN l.source='human' AND r.status='unsubmitted' THEN 'left' WHEN l.source='human' THEN 'right' ELSE 'right' END AS text,
 CASE WHEN l.source IS NULL THEN CASE WHEN r.status='unsubmitted' THEN 'model' ELSE 'human' END WHEN r.updated IS NULL THEN CASE WHEN l.source='human' THEN 'human' ELSE 'model' END
  WHEN l.source='human' AND r.status='unsubmitted' THEN 'human' WHEN r.status='unsubmitted' THEN 'model' ELSE 'human' END AS source FROM local_grades l FULL JOIN remote_grades r USING (assignment_id, user_id)""", GR)
def priority_merge(feed):
    left = feed.local_grades.select(*AU, F.lit("left").alias("text"), F.when(c("source") == "human", "human").otherwise("model").alias("source"))
    right = feed.remote_grades.select(*AU, F.lit("right").alias("text"), F.when(c("status") == "unsubmitted", "model").otherwise("human").alias("source"))
    return merges.priority_merge(left, right, AU)


@query("stale_report_check", """SELECT page_id, CASE WHEN page_id%5=0 THEN 'not in the report' WHEN page_id%7=0 THEN 'changed since verify' ELSE 'failing' END AS problem FROM pages WHERE page_id%5=0 OR page_id%7=0 OR page_id%11=0""")
def stale_report_check(feed):
    report = feed.pages.where("page_id % 5 <> 0").select("page_id", (c("page_id") % 11 != 0).alias("ok"),
                                                         F.sha2(F.when(c("page_id") % 7 == 0, "old").otherwise(c("html")), 256).alias("sha256"))
    return merges.check_report(feed.pages, report, "page_id")


@query("change_plan", """SELECT page_id, kind, CASE WHEN page_id%9=0 THEN 'empty original' WHEN kind='quiz' THEN 'kind not selected' WHEN page_id%4=1 THEN 'excluded' WHEN page_id%4=2 THEN 'styled body is empty' WHEN page_id%4=3 THEN 'identical' END AS skip,
 length(html) AS from_chars, CASE WHEN page_id%9=0 THEN NULL WHEN page_id%4=2 THEN 4 WHEN page_id%4=3 THEN length(html) ELSE length(html)+3 END AS to_chars FROM (SELECT *, CASE WHEN page_id%6=0 THEN 'quiz' ELSE 'page' END AS kind FROM pages)""")
def change_plan(feed):
    k = c("page_id")
    styled = F.when(k % 9 == 0, F.lit(None)).when(k % 4 == 2, "<p> ").when(k % 4 == 3, c("html")).otherwise(F.concat("html", F.lit("<b>")))
    rows = feed.pages.select("page_id", F.when(k % 6 == 0, "quiz").otherwise("page").alias("kind"), c("html").alias("original"), styled.alias("styled"))
    return merges.change_plan(rows, "page_id", ["page"], excluded=feed.pages.where("page_id % 4 = 1"))


# ------------------------------------------------------------------- quizzes
@query("quiz_review", """SELECT t.user_id, b.quiz_id, b.question_id, b.position, b.question_type, CASE WHEN b.question_type IN ('essay_question','file_upload_question') THEN coalesce(a.text, '(no written answer)')
  ELSE coalesce(CASE a.answer_id WHEN 'a' THEN p_name WHEN 'b' THEN CASE WHEN p_size%9<>0 THEN 'other' END END, '(no choice recorded)') END AS response, a.points, CAST(p_size AS DOUBLE) AS points_possible, a.correct,
 b.question_type IN ('essay_question','file_upload_question') AS manual FROM (SELECT DISTINCT user_id, quiz_id FROM quiz_answers) t JOIN bank b USING (quiz_id) LEFT JOIN quiz_answers a ON a.user_id=t.user_id AND a.question_id=b.question_id""", "bank quiz_answers")
def quiz_review(feed):
    takers = feed.quiz_answers.select("user_id", "quiz_id").distinct()
    return quizzes.quiz_review(feed.bank, takers, feed.quiz_answers, "user_id")


def shaped(feed):
    none = lambda t: F.lit(None).cast(t)
    raw = feed.bank.select("quiz_id", "question_id", none("string").alias("name"), c("name").alias("question_name"), F.concat(F.lit("<p>Which "), "name", F.lit("</p>")).alias("text"), none("string").alias("question_text"),
                           none("string").alias("type"), "question_type", none("double").alias("points"), "points_possible", "answers")
    return quizzes.question_shape(raw, ["quiz_id", "question_id"])


@query("question_shape", "SELECT quiz_id, question_id, p_name AS name, question_type AS type, CAST(p_size AS DOUBLE) AS points, n FROM bank", "bank")
def question_shape(feed):
    return shaped(feed).select("quiz_id", "question_id", "name", "type", "points", F.size("answers").alias("n"))


@query("quiz_check", """WITH q AS (SELECT *, question_type IN ('multiple_choice_question','true_false_question') AS one FROM bank), r AS (
 SELECT quiz_id, question_id AS w, 'fail' AS level, 'unknown type' AS rule FROM q WHERE question_type IN ('hologram_question','file_upload_question')
 UNION ALL SELECT quiz_id, question_id, 'fail', 'blank answer' FROM q WHERE p_size%9=0 AND question_type IN ('multiple_choice_question','true_false_question','multiple_answers_question')
 UNION ALL SELECT quiz_id, question_id, 'fail', 'true/false needs two' FROM q WHERE question_type='true_false_question' AND n<>2
 UNION ALL SELECT quiz_id, question_id, 'fail', 'no correct answer' FROM q WHERE (one OR question_type='multiple_answers_question') AND good=0
 UNION ALL SELECT quiz_id, question_id, 'fail', 'several correct answers' FROM q WHERE one AND good>1
 UNION ALL SELECT quiz_id, p_name, 'fail', 'duplicate name' FROM q GROUP BY quiz_id, p_name HAVING count(*)>1) SELECT quiz_id, w AS "where", level, rule FROM r""", "bank")
def quiz_check(feed):
    return quizzes.quiz_check(shaped(feed), "quiz_id", "question_id")


@query("quiz_profile", """SELECT quiz_id, CAST(sum(n) AS BIGINT) AS questions, sum(p) AS points, list_sort(list({'type': question_type, 'n': n})) AS types FROM
 (SELECT quiz_id, question_type, count(*) AS n, sum(p_size)::DOUBLE AS p FROM bank GROUP BY ALL) GROUP BY quiz_id""", "bank")
def quiz_profile(feed):
    return quizzes.quiz_profile(shaped(feed), "quiz_id")


@query("class_rubric", """SELECT quiz_id, '_quiz_auto' AS criterion_id, 'Already scored' AS label, sum(p_size)::DOUBLE AS points, true AS locked, 0 AS position FROM bank WHERE question_type NOT IN ('essay_question','file_upload_question') GROUP BY quiz_id
 UNION ALL SELECT quiz_id, 'q' || question_id, p_name, CAST(p_size AS DOUBLE), false, CAST(position AS INT) FROM bank WHERE question_type IN ('essay_question','file_upload_question')""", "bank")
def class_rubric(feed):
    auto = feed.bank.where(~c("question_type").isin(*quizzes.MANUAL_TYPES)).groupBy("quiz_id").agg(F.sum("points_possible").alias("auto_possible"))
    return quizzes.class_rubric(feed.bank, auto, "quiz_id")


@query("assignment_rubric", """SELECT assignment_id, criterion_id, label, points FROM rubric WHERE CAST(assignment_id AS INT)%4<>0
 UNION ALL SELECT CAST(p_partkey AS VARCHAR), '_overall', 'Overall', CASE WHEN p_size%5=0 THEN 100.0 ELSE CAST(p_size AS DOUBLE) END FROM part WHERE p_partkey%4=0""", "rubric")
def assignment_rubric(feed):
    work = feed.part.select(c("p_partkey").cast("string").alias("assignment_id"), F.when(c("p_size") % 5 == 0, 0.0).otherwise(c("p_size").cast("double")).alias("points_possible"))
    return quizzes.assignment_rubric(work, feed.rubric.where("cast(assignment_id as int) % 4 <> 0"))


@query("quiz_fold_auto", """SELECT user_id, quiz_id, round(w,2) AS written, round(w+a,2) AS total FROM (SELECT user_id, quiz_id, coalesce(sum(points) FILTER (WHERE m),0) AS w, coalesce(sum(points) FILTER (WHERE NOT m AND correct),0) AS a
 FROM (SELECT q.*, b.question_type IN ('essay_question','file_upload_question') AS m FROM quiz_answers q JOIN bank b USING (quiz_id, question_id)) GROUP BY ALL)""", "bank quiz_answers")
def quiz_fold_auto(feed):
    rows = feed.quiz_answers.join(feed.bank.select("quiz_id", "question_id", "question_type"), ["quiz_id", "question_id"])
    manual = c("question_type").isin(*quizzes.MANUAL_TYPES)
    per = rows.groupBy("user_id", "quiz_id").agg(
        F.map_from_entries(F.collect_list(F.when(manual, F.struct(F.concat(F.lit("q"), "question_id"), "points")))).alias("written"),
        F.sum(F.when(~manual & c("correct"), c("points"))).alias("auto"))
    return per.select("user_id", "quiz_id", quizzes.fold_auto(c("written"), c("auto")).alias("f")).select("user_id", "quiz_id", "f.written", "f.total")


@query("question_scores", """SELECT user_id, quiz_id, question_id, CASE WHEN own THEN points+1 ELSE points END AS points FROM
 (SELECT *, CAST(question_id AS INT)%4=0 AS own FROM quiz_answers) WHERE points IS NOT NULL""", "quiz_answers")
def question_scores(feed):
    """Question points to post: those recorded per question win over the rubric's cells; other cells are no questions."""
    own = c("question_id").cast("int") % 4 == 0
    cell = lambda cond, key, value: F.when(cond, F.struct(key.alias("k"), value.alias("v")))
    pairs = lambda x: F.map_from_entries(F.array_compact(F.collect_list(x)))
    per = feed.quiz_answers.groupBy("user_id", "quiz_id").agg(
        pairs(cell(own, c("question_id"), c("points") + 1)).alias("recorded"), pairs(cell(F.lit(True), F.concat(F.lit("q"), "question_id"), c("points"))).alias("cells"))
    cells = F.map_concat("cells", F.create_map(F.lit("_quiz_auto"), F.lit(3.0), F.lit("qx"), F.lit(1.0)))
    return per.select("user_id", "quiz_id", F.explode(quizzes.question_scores(c("recorded"), cells)).alias("question_id", "points"))


@query("latest_attempt", """SELECT l_orderkey AS user_id, coalesce(x.q, '-') AS question_id FROM (SELECT l_orderkey, max({'a': l_linenumber, 'q': CAST(l_partkey AS VARCHAR)}) FILTER (WHERE l_returnflag<>'N') AS x FROM lineitem GROUP BY 1)""")
def latest_attempt(feed):
    data = F.when(c("l_returnflag") != "N", F.array(c("l_partkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = feed.lineitem.groupBy(c("l_orderkey").alias("user_id")).agg(F.collect_list(F.struct(c("l_linenumber").alias("attempt"), data.alias("data"))).alias("h"))
    return rows.select("user_id", quizzes.latest_attempt(c("h"), F.array(F.lit("-")))[0].alias("question_id"))


@query("latest_comment", """SELECT course_id, trim(x.t) AS comment FROM (SELECT user_id AS course_id, max({'ts': ts, 'id': event_id, 't': CASE WHEN event_id%4=0 THEN ' ' ELSE event_type || ' ' || event_id END}) FILTER (WHERE event_id%4<>0) AS x
 FROM events WHERE event_type IN ('click','view') GROUP BY 1) WHERE x IS NOT NULL""")
def latest_comment(feed):
    text = F.when(c("event_id") % 4 == 0, " ").otherwise(F.concat_ws(" ", F.lit(""), "event_type", c("event_id").cast("string")))
    rows = feed.events.select(c("user_id").alias("course_id"), F.when(c("event_type").isin("click", "view"), "me").otherwise("them").alias("author_id"), text.alias("comment"),
                              c("ts").alias("created_at"), c("event_id").alias("comment_id"))
    return quizzes.latest_comment(rows, ["course_id"], F.lit("me"))


@query("was_submitted", """SELECT o_orderkey, o_orderstatus='F' OR o_orderkey%9=0 OR (o_orderpriority='1-URGENT') OR o_orderkey%8=0 OR (o_orderkey%5=0 AND o_orderkey%15<>0 AND o_orderstatus='O') AS taken FROM orders""")
def was_submitted(feed):
    k = c("o_orderkey")
    history = F.array(F.struct(F.lit(None).cast("timestamp").alias("submitted_at"), F.lit(0).alias("attempt"), F.when(k % 8 == 0, 3).otherwise(0).alias("n_data")))
    sub = F.struct(F.when(c("o_orderstatus") == "F", c("o_orderdate")).alias("submitted_at"), F.when(k % 9 == 0, 1).alias("attempt"),
                   F.when(c("o_orderpriority") == "1-URGENT", "online_quiz").otherwise("none").alias("submission_type"), history.alias("history"),
                   (k % 15 == 0).alias("missing"), F.when(c("o_orderstatus") == "O", "graded").otherwise("unsubmitted").alias("workflow_state"), c("o_totalprice").alias("score"))
    types = F.when(k % 5 == 0, F.array(F.lit("external_tool"))).otherwise(F.array(F.lit("online_upload")))
    return feed.orders.select("o_orderkey", quizzes.was_submitted(sub, types).alias("taken"))


@query("answer_is_blank", """SELECT l_linenumber, l_returnflag, l_linenumber IN (1,2,3,4,6,7) AND l_returnflag<>'R' AS blank, count(*) AS n FROM lineitem GROUP BY ALL""")
def answer_is_blank(feed):
    texts = F.array(*[F.lit(t) for t in ("N/A", " none. ", "", "Skipped", "nothing to say", "(no written answer)", "n / a")])
    kind = F.when(c("l_returnflag") == "R", "file_upload_question").otherwise("essay_question")
    return feed.lineitem.groupBy("l_linenumber", "l_returnflag", quizzes.answer_is_blank(F.element_at(texts, c("l_linenumber")), kind).alias("blank")).agg(F.count(F.lit(1)).alias("n"))


@query("hold_for_review", """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag='R' AND l_linestatus='O' AND NOT (l_linenumber<4 AND l_quantity>25) AS hold FROM lineitem""")
def hold_for_review(feed):
    review = F.array(F.struct(F.lit("7").alias("id"), F.lit("essay_question").alias("type"), F.lit(True).alias("manual"), F.when(c("l_linenumber") < 4, "n/a").otherwise("words").alias("response")))
    scored = F.when(c("l_quantity") > 25, F.create_map(F.lit("q7"), F.lit(0.0))).otherwise(F.create_map(F.lit("q8"), F.lit(0.0)))
    return feed.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", quizzes.hold_for_review(c("l_returnflag") == "R", c("l_linestatus") == "F", review, scored).alias("hold"))


@query("needs_written", """SELECT o_orderkey, o_orderkey%4>0 AND o_orderstatus<>'F' AND (o_orderstatus='P' OR o_totalprice <= 300000-10000*(o_orderkey%4)+0.05) AS needs FROM orders""")
def needs_written(feed):
    state = F.when(c("o_orderstatus") == "F", "complete").when(c("o_orderstatus") == "P", "pending_review").otherwise("untaken")
    n = c("o_orderkey") % 4
    return feed.orders.select("o_orderkey", quizzes.needs_written(state, c("o_totalprice"), n, n * 10000, F.lit(300000.0)).alias("needs"))


@query("posting_state", "SELECT assignment_id, count(*) FILTER (WHERE score IS NOT NULL AND posted_at IS NOT NULL) AS live, count(*) FILTER (WHERE score IS NOT NULL AND posted_at IS NULL) AS hidden FROM remote_grades GROUP BY 1", GR)
def posting_state(feed):
    return quizzes.posting_state(feed.remote_grades, ["assignment_id"])


POSTED = """SELECT assignment_id, user_id, r.status, r.score, coalesce(r.score IS NOT NULL AND r.posted_at IS NOT NULL AND CASE WHEN l.source IS NOT NULL AND l.source<>'no-submission' THEN l.total=r.score WHEN r.needs_written THEN r.score<>20 ELSE true END, false) AS whole,
 r.needs_written AS still_open FROM remote_grades r LEFT JOIN local_grades l USING (assignment_id, user_id)"""


def posted(feed):
    rows = feed.remote_grades.join(feed.local_grades.select(*AU, "total", "source"), AU, "left")
    open_ = quizzes.quiz_still_open(c("status"), F.lit(None).cast("string"), c("needs_written"))
    return rows.select(*AU, "status", "score", quizzes.whole_grade_posted(c("score"), c("posted_at"), c("total"), c("source"), open_, F.lit(20.0)).alias("whole"), open_.alias("still_open"))


@query("whole_grade_posted", POSTED, GR)
def whole_grade_posted(feed):
    return posted(feed)


@query("assignment_graded", f"""SELECT CAST(p_partkey AS VARCHAR) AS assignment_id, coalesce(n,0) AS turned_in, CASE WHEN coalesce(n,0)=0 THEN p_size%4=0 AND p_size%3=0 ELSE u=0 END AS graded FROM part LEFT JOIN
 (SELECT assignment_id, count(*) FILTER (WHERE status<>'unsubmitted') AS n, count(*) FILTER (WHERE status<>'unsubmitted' AND NOT whole AND (still_open OR score IS NULL)) AS u FROM ({POSTED}) GROUP BY 1) ON assignment_id=CAST(p_partkey AS VARCHAR)""", GR)
def assignment_graded(feed):
    rows = posted(feed).select("assignment_id", "status", c("whole").alias("whole_posted"), F.lit(False).alias("recorded"), "still_open", "score")
    work = feed.part.select(c("p_partkey").cast("string").alias("assignment_id"), (c("p_size") % 4).alias("needs_grading"), (c("p_size") % 3 == 0).alias("has_submissions"))
    return quizzes.assignment_graded(rows, work)
