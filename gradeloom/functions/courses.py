"""Course names, term codes and the kinds of dated work, from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season digits of a term code, and the bucket for everything else.
SEASONS = (("10", "Spring"), ("20", "Summer"), ("30", "Fall"), ("40", "Winter"))
OTHER_TERM = "Sandboxes and other"
TERM_CODE = r"\b(20\d{2}(?:10|20|30|40))\b"
# The parts of a registrar's course name.
COURSE_CODE = r"\b([A-Z]{2,4})\s*[- ]?\s*(\d{4})\b"
TERM_PREFIX = r"^\s*\d{4,6}\s+"
CODE_PREFIX = r"^\s*[A-Z]{2,4}\s*-?\s*\d{3,4}\s+"
SECTION = r"^(?:\d{2,4}|[A-Z]{2,4})\s+"
MODE_SUFFIX = (r"(?i)\s*\(\s*(?:online|web|hybrid|blended|remote|virtual|in[- ]?person|face[- ]?to[- ]?face|f2f|"
               r"a?synchronous)\s*\)\s*$")
# Words that name a kind of assessment; the first kind that fits is the kind.
PROCTORED = r"(?i)\bproctor\w*\b"
LOGISTICS = r"(?i)^\s*(?:schedule|sign[ -]?up|register|book)\b"
PRACTICE = r"(?i)\b(?:practice|prep|study guide|sample|mock)\b(?!\s*\d)"
FINAL = r"(?i)\bfinal\b[^a-z]{0,12}(?:exam|assessment)\b|\b(?:exam|assessment)\b[^a-z]{0,12}\bfinal\b"
MIDTERM = r"(?i)\bmidterm\b"
TEST = r"(?i)\btests?\b(?!\s*[- ]?\s*(?:bench|case|cases|suite|plan|driven|harness|bed))"
EXAM = r"(?i)\bexams?\b"
QUIZ = r"(?i)\bquiz(?:zes)?\b"
EXAM_KINDS = ("final", "exam", "test")


def term_label(code: Column) -> Column:
    season = F.substring(code, 5, 2)
    name = F.lit(None).cast("string")
    for digits, word in SEASONS:
        name = F.when(season == digits, word).otherwise(name)
    return F.concat_ws(" ", name, F.substring(code, 1, 4))


def term_of(course_code: Column, name: Column, term_name: Column) -> Column:
    """Struct(code, label, sort): a code in the course, else in the term's name, else season and year."""
    def code_in(text):
        got = F.regexp_extract(F.coalesce(text, F.lit("")), TERM_CODE, 1)
        return F.when(got != "", got)
    term = F.trim(F.coalesce(term_name, F.lit("")))
    real = (term != "") & (F.lower(term) != "default term")
    year = F.regexp_extract(term, r"\b(20\d{2})\b", 1)
    spelled = F.lit(None).cast("string")
    for digits, word in reversed(SEASONS):
        spelled = F.when(F.lower(term).contains(word.lower()) & (year != ""), F.concat(year, F.lit(digits))).otherwise(spelled)
    code = F.coalesce(code_in(F.concat_ws(" ", course_code, name)), F.when(real, F.coalesce(code_in(term), spelled)))
    label = F.when(code.isNotNull(), term_label(code)).when(real, term).otherwise(OTHER_TERM)
    return F.struct(code.alias("code"), label.alias("label"), F.coalesce(code.cast("int"), F.lit(-1)).alias("sort"))


def course_badge(course_code: Column, name: Column, course_id: Column) -> Column:
    """A short code such as "MAT 2323", else the start of the name."""
    def short(text):
        up = F.upper(F.coalesce(text, F.lit("")))
        return F.when(up.rlike(COURSE_CODE), F.concat_ws(" ", F.regexp_extract(up, COURSE_CODE, 1), F.regexp_extract(up, COURSE_CODE, 2)))
    plain = F.left(F.trim(F.coalesce(F.when(course_code != "", course_code), name, F.lit(""))), F.lit(14))
    return F.coalesce(short(course_code), short(name), F.when(plain != "", plain), F.concat(F.lit("course "), course_id))


def course_title(name: Column, badge: Column) -> Column:
    """What a person calls the course: registrar's prefix and delivery mode taken off."""
    full = F.trim(F.coalesce(name, F.lit("")))
    rest = F.regexp_replace(full, TERM_PREFIX, "")
    coded = F.regexp_replace(rest, CODE_PREFIX, "")
    unsectioned = F.regexp_replace(coded, SECTION, "")
    keeps_title = (coded != rest) & (F.size(F.split(F.trim(unsectioned), r"\s+")) >= 2)
    bare = F.regexp_replace(F.when(keeps_title, unsectioned).otherwise(coded), MODE_SUFFIX, "")
    bare = F.regexp_replace(bare, r"^[ \-–—:]+|[ \-–—:]+$", "")
    return F.when(full == "", badge).when(bare != "", bare).otherwise(full)


def item_kind(name: Column, types: Column, is_quiz: Column) -> Column:
    """The kind of a dated item; order is part of the rule."""
    name = F.coalesce(name, F.lit(""))
    has = lambda t: F.coalesce(F.array_contains(types, t), F.lit(False))
    quiz = F.coalesce(is_quiz, F.lit(False)) | has("online_quiz")
    assessed = name.rlike(TEST) | name.rlike(EXAM) | name.rlike(QUIZ)
    return (F.when(has("discussion_topic"), "discussion").when(has("not_graded"), "ungraded")
            .when(name.rlike(LOGISTICS), "assignment").when(name.rlike(PRACTICE) & assessed, "practice")
            .when(name.rlike(FINAL), "final").when(name.rlike(MIDTERM) | name.rlike(TEST), "test")
            .when(name.rlike(EXAM), "exam").when(name.rlike(QUIZ) | quiz, "quiz").otherwise("assignment"))
