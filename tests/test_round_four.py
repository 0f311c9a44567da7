"""Joins that stay small where tables are exploded, and versions that meet in one shuffle."""

from __future__ import annotations

import os
import re

from gradeloom.operators import files, grading, identity, quizzes
from gradeloom.staging import shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_names_are_not_sent_to_the_driver(spark):
    roster = spark.createDataFrame([("c", "Student-1", "Maria Vobcde"), ("c", "Student-2", "Omar Vofghi")], "course_id string, tag string, name string")
    texts = spark.createDataFrame([("c", 1, "On Monday tell Maria Vobced about it.")], "course_id string, text_id int, text string")
    got = identity.near_name(texts, roster)
    assert re.search(r"SortMergeJoin \[course_id#\d+, g#\d+", plan(got))
    assert [(r.wrote, r.tag, r.distance) for r in got.collect()] == [("Maria Vobced", "Student-1", 1)]


def test_only_the_nearest_spellings_are_kept(spark):
    names = [f"Zed{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"]
    people = spark.createDataFrame([("c", n, f"Student-{i}") for i, n in enumerate(names)] + [("c", names[5], f"Student-{900 + i}") for i in range(9)]
                                   + [(None, "Zedaaa", "Student-1"), ("c", None, "Student-2")], "course_id string, name string, tag string")
    written = spark.createDataFrame([("c", n) for n in names] + [("c", "ZEDBBBX"), ("c", "Quentin"), (None, "Zedaaa"), ("c", None)], "course_id string, written string")
    before = set(os.listdir(shared_folder(spark)))
    got = {(r.written, r.place): (r.name, r.tag, r.distance) for r in identity.nearest_names(written, people).collect()}
    staged = [spark.read.parquet(os.path.join(shared_folder(spark), f)) for f in set(os.listdir(shared_folder(spark))) - before]
    assert max(df.count() for df in staged) <= 3 * (len(names) + 3)
    assert got[names[5], 1] == (names[5], "Student-5", 0) and got[names[5], 3] == (names[5], "Student-901", 0)
    assert [got["Zedaaa", i] for i in (1, 2, 3)] == [("Zedaaa", "Student-0", 0), ("Zedaab", "Student-1", 1), ("Zedaac", "Student-2", 1)]
    assert got["ZEDBBBX", 1] == ("Zedbbb", "Student-21", 1) and not [k for k in got if k[0] is None]


def test_words_that_survive_meet_in_one_shuffle(spark):
    old = spark.createDataFrame([(1, "the a/b ./c /gone the cat it's x-\n--"), (1, "more the"), (2, None), (None, "lost words"), (3, "-- /x")], "k int, text string")
    new = spark.createDataFrame([(1, "ab c the its"), (1, "X cat"), (None, "lost words")], "k int, text string")
    got = files.text_survival(old, new, "k")
    assert len(re.findall("Exchange ", plan(got))) == 1
    # the ab c the cat its x, more the: x and more are missing (X is another word)
    assert {r.k: (r.words, r.missing) for r in got.collect()} == {1: (9, 2), None: (2, 2)}


def test_words_that_differ_meet_in_one_shuffle(spark):
    old = spark.createDataFrame([(1, "a a b <b>c</b>"), (2, "same"), (None, "x")], "k int, html string")
    new = spark.createDataFrame([(1, "a b b d d"), (2, "same"), (None, "y")], "k int, html string")
    got = files.word_diff(old, new, "k")
    assert len(re.findall("Exchange ", plan(got))) == 1
    assert {(r.k, r.side, r.word, r["count"], r.place, r.total) for r in got.collect()} == {
        (1, "lost", "a", 1, 1, 2), (1, "lost", "c", 1, 2, 2), (1, "gained", "d", 2, 1, 3), (1, "gained", "b", 1, 2, 3)}


def test_quiz_answers_travel_together(spark):
    choice = "struct<id:string,text:string>"
    bank = spark.createDataFrame([("z", "q1", 1, "multiple_choice_question", 2.0, [("a", "<i>A</i>"), ("b", "B"), ("a", "later")]),
                                  ("z", "q2", 2, "essay_question", 2.0, []), ("z", None, 3, "essay_question", 1.0, None)],
                                 f"quiz_id string, question_id string, position int, question_type string, points_possible double, answers array<{choice}>")
    takers = spark.createDataFrame([("u", "z"), ("v", "z"), (None, "z"), ("w", None)], "user_id string, quiz_id string")
    answers = spark.createDataFrame([("u", "z", "q1", "a", None, 1.0, True), ("u", "z", "q1", "x", None, 0.0, False), ("u", "z", "q2", None, "<p>t</p>", 2.0, None),
                                     ("u", "other", "q1", "a", None, 1.0, True), (None, "z", "q1", "a", None, 1.0, True)],
                                    "user_id string, quiz_id string, question_id string, answer_id string, text string, points double, correct boolean")
    got = quizzes.quiz_review(bank, takers, answers, "user_id")
    assert not re.search(r"Join \[user_id#\d+, quiz_id#\d+, question_id#\d+", plan(got))
    none = "(no written answer)"
    want = [("u", "q1", "A", 1.0), ("u", "q1", "(no choice recorded)", 0.0), ("u", "q2", "t", 2.0), ("u", None, none, None)]
    want += [(u, q, r, None) for u in ("v", None) for q, r in (("q1", "(no choice recorded)"), ("q2", none), (None, none))]
    assert sorted(map(repr, ((r.user_id, r.question_id, r.response, r.points) for r in got.collect()))) == sorted(map(repr, want))


def test_scores_look_up_their_rubric(spark):
    rows = spark.createDataFrame([("a", f"u{i}", {"x": float(i), "y": 1.0}) for i in range(8)], "assignment_id string, user_id string, scores map<string,double>")
    rubric = spark.createDataFrame([("a", "x", "X", 100.0), ("a", "y", "Y", 1.0)], "assignment_id string, criterion_id string, label string, points double")
    health = grading.rubric_health(rows, rubric, ["assignment_id"])
    assert "ShuffledHashJoin" in plan(health) and "BroadcastHashJoin" not in plan(health)
    got = grading.weak_row_evidence(rows, health, ["assignment_id"], "user_id")
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert [(r.criterion_id, r.place, r.user_id) for r in got.orderBy("place").collect()] == [("x", i + 1, f"u{i}") for i in range(6)]
