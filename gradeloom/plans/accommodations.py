"""Standing accommodations and the per-quiz extensions they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a grant may hold.
KINDS = ("percent", "minutes")
LIMITS = {"percent": (1, 400), "minutes": (1, 10080), "extra_attempts": (0, 20)}


def extra_minutes(kind: Column, percent: Column, minutes: Column, time_limit: Column) -> Column:
    """Extra minutes for a quiz, rounded up; null where there is nothing to extend."""
    by_share = F.when(time_limit > 0, F.ceil(time_limit * percent / 100.0).cast("int"))
    return F.when(kind == "minutes", F.when(minutes != 0, minutes)).otherwise(by_share)


def reject_reason(grant: DataFrame) -> DataFrame:
    """Why a typed grant is refused; null where it is fine."""
    outside = lambda c: ~F.col(c).between(*LIMITS[c])
    why = (F.when(~F.col("user_id").rlike(r"^\d+$"), "not a user id").when(~F.col("kind").isin(*KINDS), "unknown kind")
           .when((F.col("kind") == "percent") & outside("percent"), "percent out of range")
           .when((F.col("kind") == "minutes") & outside("minutes"), "minutes out of range")
           .when(outside("extra_attempts"), "attempts out of range"))
    return grant.withColumn("reject", why)


def accommodation_plan(grants: DataFrame, enrolled: DataFrame, quizzes: DataFrame, existing: DataFrame) -> DataFrame:
    """Enrolled students times their courses' quizzes: the change to send, or why none is.

    ``grants``: user_id, kind, percent, minutes, extra_attempts, manually_unlocked. ``existing``:
    quiz_id, user_id, extra_time, extra_attempts, manually_unlocked; there 0 and null mean the same.
    """
    have = existing.select("quiz_id", "user_id", F.col("extra_time").alias("h_time"), F.col("extra_attempts").alias("h_attempts"),
                           F.col("manually_unlocked").alias("h_open"))
    rows = grants.join(enrolled, "user_id").join(quizzes, "course_id").join(have, ["quiz_id", "user_id"], "left")
    c = F.col
    time = extra_minutes(c("kind"), c("percent"), c("minutes"), c("time_limit"))
    attempts = F.when(c("extra_attempts") != 0, c("extra_attempts"))
    unlocked = F.when(c("manually_unlocked"), True)
    rows = rows.select("course_id", "quiz_id", "user_id", "h_time", "h_attempts", "h_open", time.alias("extra_time"),
                       attempts.alias("extra_attempts"), unlocked.alias("manually_unlocked"))
    nothing = F.coalesce("extra_time", "extra_attempts").isNull() & c("manually_unlocked").isNull()
    zero = lambda n: F.coalesce(n, F.lit(0))
    same = ((c("extra_time").isNull() | (zero("h_time") == c("extra_time")))
            & (c("extra_attempts").isNull() | (zero("h_attempts") == c("extra_attempts")))
            & (c("manually_unlocked").isNull() | F.coalesce("h_open", F.lit(False))))
    why = F.when(nothing, "no time limit").when(same, "already set")
    return rows.select("course_id", "quiz_id", "user_id", "extra_time", "extra_attempts", "manually_unlocked", why.alias("why"))


def accommodation_batches(plan: DataFrame) -> DataFrame:
    """One batch per quiz; grants are few per quiz, so the list stays short."""
    return plan.where("why IS NULL").groupBy("course_id", "quiz_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("extra_time").alias("minutes"),
        F.array_sort(F.collect_list(F.struct("user_id", "extra_time", "extra_attempts"))).alias("extensions"))
