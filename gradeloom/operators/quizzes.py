"""Quiz banks, attempts and the written questions inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.html import ANY_TAG, html_to_text
from gradeloom.functions.scores import is_scored, same_score

# Question types by how they are graded.
MANUAL_TYPES = ("essay_question", "file_upload_question")
KNOWN_TYPES = ("multiple_choice_question", "true_false_question", "short_answer_question", "essay_question", "multiple_answers_question",
               "fill_in_multiple_blanks_question", "matching_question", "numerical_question", "text_only_question")
ONE_CORRECT = ("multiple_choice_question", "true_false_question")
NO_ANSWERS = ("essay_question", "text_only_question")
BLANK = r"(?i)^\s*(?:n\s*/\s*a|na|none|blank|skipped|\(no written answer\))?\s*\.?\s*$"
PENDING = "pending_review"


def was_submitted(sub: Column, types: Column) -> Column:
    """Did the student take it: a time, an attempt, a quiz type, any history with data, or an
    external tool's score. ``sub`` is a struct of the submission row."""
    tried = sub["submitted_at"].isNotNull() | (F.coalesce(sub["attempt"], F.lit(0)) > 0)
    by_type = F.coalesce(sub["submission_type"].isin("online_quiz", "external_tool", "basic_lti_launch"), F.lit(False))
    history = F.coalesce(F.exists(sub["history"], lambda h: h["submitted_at"].isNotNull() | (F.coalesce(h["attempt"], F.lit(0)) > 0)
                                  | (F.coalesce(h["n_data"], F.lit(0)) > 0)), F.lit(False))
    outside = (F.coalesce(F.array_contains(types, "external_tool"), F.lit(False)) & ~F.coalesce(sub["missing"], F.lit(False))
               & F.coalesce(sub["workflow_state"].isin("graded", "submitted", PENDING), F.lit(False)) & sub["score"].isNotNull())
    return tried | by_type | history | outside


def answer_is_blank(text: Column, kind: Column) -> Column:
    """Nothing turned in; a file upload without text may still hold a file."""
    uploads = F.coalesce(kind.isin("file_upload_question", "file_upload"), F.lit(False))
    return ~uploads & F.trim(F.coalesce(text, F.lit(""))).rlike(BLANK)


def _manual(review: Column) -> Column:
    return F.filter(review, lambda q: q["manual"])


def written_answers_blank(review: Column) -> Column:
    return (F.size(_manual(review)) > 0) & F.forall(_manual(review), lambda q: answer_is_blank(q["response"], q["type"]))


def written_scores_recorded(review: Column, scores: Column) -> Column:
    """Every written question has a number; zero counts."""
    return (F.size(_manual(review)) > 0) & F.forall(
        _manual(review), lambda q: F.try_element_at(scores, F.concat(F.lit("q"), q["id"])).isNotNull())


def hold_for_review(needs_human: Column, human_ok: Column, review: Column, scores: Column) -> Column:
    return (F.coalesce(needs_human, F.lit(False)) & ~F.coalesce(human_ok, F.lit(False))
            & ~(written_answers_blank(review) & written_scores_recorded(review, scores)))


def needs_written(state: Column, score: Column, manual_questions: Column, manual_points: Column, possible: Column) -> Column:
    """Written points are not inside the automatic score yet."""
    state = F.lower(F.coalesce(state, F.lit("")))
    low = (possible <= 0) | (F.coalesce(score, F.lit(0.0)) <= possible - manual_points + 0.05)
    return (manual_questions > 0) & (state != "complete") & ((state == PENDING) | low)


def latest_attempt(history: Column, current: Column) -> Column:
    """Answers of the last attempt that has any, else the current ones."""
    full = F.array_sort(F.filter(history, lambda h: F.size(h["data"]) > 0))
    return F.when(F.size(full) > 0, F.element_at(full, -1)["data"]).otherwise(current)


def latest_comment(comments: DataFrame, keys: list[str], author: Column) -> DataFrame:
    """The newest non-empty comment of one author per submission."""
    mine = comments.where((F.col("author_id") == author) & (F.trim("comment") != ""))
    return mine.groupBy(*keys).agg(F.max_by(F.trim("comment"), F.struct("created_at", "comment_id")).alias("comment"))


def quiz_review(bank: DataFrame, takers: DataFrame, answers: DataFrame, user: str) -> DataFrame:
    """Every question of a taken quiz beside the student's answer.

    ``takers``: user, quiz_id. ``answers``: user, quiz_id, question_id, answer_id, text, points, correct.
    """
    # markup is cleaned once per choice and once per answer, before the questions fan out over the takers
    key = ["quiz_id", "question_id"]
    choices = bank.select(*key, F.posexplode("answers").alias("_at", "a")).select(*key, F.col("a.id").alias("answer_id"), "_at", html_to_text(F.col("a.text")).alias("_c"))
    choices = choices.groupBy(*key, "answer_id").agg(F.min_by("_c", "_at").alias("_choice"))
    asked = bank.drop("answers").join(choices.groupBy(*key).agg(F.collect_list(F.struct("answer_id", "_choice")).alias("_choices")), key, "left")
    # a student's answers to one quiz travel together, and the quiz's questions come to them last
    text = F.when(F.col("text").isNotNull(), html_to_text(F.col("text")))
    given = answers.select(user, "quiz_id", F.struct("question_id", "answer_id", "points", "correct", text.alias("_text")).alias("_a"))
    given = given.groupBy(user, "quiz_id").agg(F.collect_list("_a").alias("_given"))
    rows = takers.join(given, [user, "quiz_id"], "left").join(asked, "quiz_id")
    own = F.filter("_given", lambda g: g["question_id"] == F.col("question_id"))
    rows = rows.select(user, *key, "position", "question_type", "points_possible", "_choices", F.explode_outer(own).alias("_a"))
    rows = rows.select("*", "_a.answer_id", "_a.points", "_a.correct", "_a._text")
    rows = rows.withColumn("_choice", F.get(F.filter("_choices", lambda x: x["answer_id"] == F.col("answer_id")), F.lit(0))["_choice"])
    manual = F.col("question_type").isin(*MANUAL_TYPES)
    response = F.when(manual, F.coalesce(F.nullif(F.col("_text"), F.lit("")), F.lit("(no written answer)"))).otherwise(
        F.coalesce(F.nullif(F.col("_choice"), F.lit("")), F.lit("(no choice recorded)")))
    return rows.select(user, "quiz_id", "question_id", "position", "question_type", response.alias("response"), "points",
                       "points_possible", "correct", manual.alias("manual"))


def fold_auto(written: Column, auto: Column) -> Column:
    """Automatic score on top of written points, as struct(written, total, scores)."""
    auto = F.coalesce(auto, F.lit(0.0))
    own = F.map_filter(written, lambda k, _v: k != "_quiz_auto")
    sum_ = F.round(F.aggregate(F.map_values(own), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 2)
    return F.struct(sum_.alias("written"), F.round(auto + sum_, 2).alias("total"),
                    F.map_concat(own, F.create_map(F.lit("_quiz_auto"), auto)).alias("scores"))


def question_scores(recorded: Column, cells: Column) -> Column:
    """Map of question to points to post: what is recorded per question, else the rubric's ``q<number>`` cells. Zero is a grade, null none."""
    own = F.map_filter(recorded, lambda k, v: v.isNotNull() & (k != ""))
    asked = F.map_filter(cells, lambda k, v: k.rlike(r"^q\d+$") & v.isNotNull())
    by_id = F.transform_keys(asked, lambda k, _v: F.substring(k, 2, 1 << 30))
    return F.map_concat(own, F.map_filter(by_id, lambda k, _v: ~F.map_contains_key(own, k)))


def question_shape(q: DataFrame, keys: list[str]) -> DataFrame:
    """Three spellings of a question to one. Column pairs: text/question_text, type/question_type,
    points/points_possible, name/question_name; answers as struct(text, answer_text, weight,
    answer_weight, correct)."""
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    weight = lambda a: F.when(a["correct"].isNotNull(), F.when(a["correct"], 100.0).otherwise(0.0)).otherwise(
        F.coalesce(a["weight"], a["answer_weight"], F.lit(0.0)))
    answers = F.transform(F.coalesce("answers", F.array().cast(q.schema["answers"].dataType)), lambda a: F.struct(
        F.coalesce(a["text"], a["answer_text"], F.lit("")).alias("text"), weight(a).alias("weight")))
    return q.select(*keys, F.coalesce(pick("name", "question_name"), F.lit("")).alias("name"),
                    F.coalesce(pick("text", "question_text"), F.lit("")).alias("text"),
                    F.coalesce(pick("type", "question_type"), F.lit("multiple_choice_question")).alias("type"),
                    F.coalesce("points", "points_possible", F.lit(1.0)).alias("points"), answers.alias("answers"))


def quiz_check(questions: DataFrame, quiz: str, question: str) -> DataFrame:
    """Question lints, one row per finding, plus names used twice within a quiz."""
    a, t = F.col("answers"), F.col("type")
    n = F.size(a)
    correct = F.size(F.filter(a, lambda x: x["weight"] > 0))
    blank = F.size(F.filter(a, lambda x: F.trim(x["text"]) == ""))
    known, none = t.isin(*KNOWN_TYPES), t.isin(*NO_ANSWERS)
    one, short, many = t.isin(*ONE_CORRECT), t == "short_answer_question", t == "multiple_answers_question"
    row = lambda cond, level, rule: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))
    found = F.array_compact(F.array(
        row(~known, "fail", "unknown type"), row(known & (F.trim(F.regexp_replace("text", ANY_TAG, "")) == ""), "fail", "empty text"),
        row(known & (F.col("points") < 0), "fail", "negative points"), row(known & ~none & (blank > 0), "fail", "blank answer"),
        row(none & (n > 0), "warn", "answers ignored"), row((t == "true_false_question") & (n != 2), "fail", "true/false needs two"),
        row(one & (n < 2), "fail", "needs two options"), row(one & (correct == 0), "fail", "no correct answer"),
        row(one & (correct > 1), "fail", "several correct answers"), row(short & (n == 0), "fail", "no accepted answer"),
        row(short & (n > 3), "warn", "many accepted answers"), row(short & n.between(1, 3) & (correct != n), "fail", "accepted answer not correct"),
        row(many & (correct == 0), "fail", "no correct answer"), row(many & (correct > 0) & (correct == n), "warn", "every answer correct")))
    own = questions.select(quiz, F.col(question).cast("string").alias("where"), F.inline(found))
    twice = questions.groupBy(quiz, F.col("name").alias("where")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND where <> ''").select(
        quiz, "where", F.lit("fail").alias("level"), F.lit("duplicate name").alias("rule"))
    return own.unionByName(twice)


def quiz_profile(questions: DataFrame, quiz: str) -> DataFrame:
    """Question count, points and count by type per quiz."""
    per = questions.groupBy(quiz, "type").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("p"))
    return per.groupBy(quiz).agg(F.sum("n").alias("questions"), F.round(F.sum("p"), 2).alias("points"),
                                 F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"))


def class_rubric(bank: DataFrame, auto: DataFrame, quiz: str) -> DataFrame:
    """The automatic part as one locked row, then each written question."""
    locked = auto.where("auto_possible > 0").select(quiz, F.lit("_quiz_auto").alias("criterion_id"), F.lit("Already scored").alias("label"),
                                                    F.col("auto_possible").alias("points"), F.lit(True).alias("locked"), F.lit(0).alias("position"))
    written = bank.where(F.col("question_type").isin(*MANUAL_TYPES)).select(
        quiz, F.concat(F.lit("q"), "question_id").alias("criterion_id"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Written response")).alias("label"),
        F.col("points_possible").alias("points"), F.lit(False).alias("locked"), F.col("position").cast("int").alias("position"))
    return locked.unionByName(written)


def assignment_rubric(assignments: DataFrame, rubric: DataFrame) -> DataFrame:
    """The rubric of each assignment; one overall row where it has none."""
    none = assignments.join(rubric.select("assignment_id").distinct(), "assignment_id", "left_anti")
    made = none.select("assignment_id", F.lit("_overall").alias("criterion_id"), F.lit("Overall").alias("label"),
                       F.coalesce(F.nullif(F.col("points_possible"), F.lit(0.0)), F.lit(100.0)).alias("points"))
    return rubric.select("assignment_id", "criterion_id", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("Criterion")).alias("label"), "points").unionByName(made)


def quiz_still_open(status: Column, lms_state: Column, needs: Column) -> Column:
    waits = lambda c: F.coalesce(c == PENDING, F.lit(False))
    return F.coalesce(needs, F.lit(False)) | waits(status) | waits(lms_state)


def whole_grade_posted(score: Column, posted_at: Column, held: Column, source: Column, still_open: Column, auto: Column) -> Column:
    """The score students see is the finished grade."""
    shown = score.isNotNull() & posted_at.isNotNull()
    return F.coalesce(shown & F.when(is_scored(held, source), same_score(held, score)).when(
        still_open, auto.isNotNull() & ~same_score(score, auto)).otherwise(True), F.lit(False))


def posting_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    has = F.col("score").isNotNull()
    return rows.groupBy(*keys).agg(F.count_if(has & F.col("posted_at").isNotNull()).alias("live"),
                                   F.count_if(has & F.col("posted_at").isNull()).alias("hidden"))


def assignment_graded(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Is every turned-in submission finished. ``rows``: assignment_id, status, whole_posted, recorded,
    still_open, score. ``assignments``: assignment_id, needs_grading, has_submissions."""
    turned_in = ~F.coalesce("status", F.lit("")).isin("", "unsubmitted")
    unfinished = turned_in & ~F.col("whole_posted") & ~F.col("recorded") & (F.col("still_open") | F.col("score").isNull())
    per = rows.groupBy("assignment_id").agg(F.count_if(turned_in).alias("_n"), F.count_if(unfinished).alias("_u"))
    j = assignments.join(per, "assignment_id", "left")
    none_in = F.coalesce("_n", F.lit(0)) == 0
    graded = F.when(none_in, (F.coalesce("needs_grading", F.lit(0)) <= 0) & F.coalesce("has_submissions", F.lit(False))).otherwise(F.col("_u") == 0)
    return j.select("assignment_id", F.coalesce("_n", F.lit(0)).alias("turned_in"), graded.alias("graded"))
