"""Gradebook statistics, curves and rubric item analysis, one job over every assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.numbers import exact_mean, exact_median
from gradeloom.functions.scores import FAIL_LETTER, LETTER_SCALE, letter, percent_of

# Item-analysis thresholds.
CEILING = 0.95
FLOOR = 0.25
WEAK_MEAN = 0.70
LOW_SPREAD = 0.08
WEAK_LINK = 0.25
MIN_N_FOR_R = 8
MIN_POOL = 3


def letter_distribution(scored: DataFrame, keys: list[str], percent: Column, scale=LETTER_SCALE) -> DataFrame:
    """Count and share per letter, empty bands kept; one shuffle, no join with the scale."""
    steps = sorted(scale, key=lambda row: -row[1])
    names = [n for n, _ in steps] + [FAIL_LETTER]
    lows = [c for _, c in steps] + [0.0]
    highs = [None] + [c for _, c in steps]
    counted = (scored.select(*keys, letter(percent, scale).alias("_l")).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col("_l") == n).alias(f"_{i}") for i, n in enumerate(names)]))
    bands = F.array(*[F.struct(F.lit(n).alias("letter"), F.col(f"_{i}").alias("count"),
                               (F.col(f"_{i}") / F.col("_n")).alias("share"), F.lit(lows[i]).alias("low"),
                               F.lit(highs[i]).cast("double").alias("high")) for i, n in enumerate(names)])
    return counted.select(*keys, F.inline(bands))


def score_stats(scored: DataFrame, keys: list[str], value: Column, possible: Column) -> DataFrame:
    """n, mean, exact median, min, max and mean percent.

    ``median`` keeps counts per distinct score, so one huge assignment merges map-side.
    """
    rows = scored.select(*keys, value.alias("_v"), possible.alias("_p"))
    out = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("_mean"), F.median("_v").alias("_med"),
                                  F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.max("_p").alias("_p"))
    zero = F.lit(0.0)
    return out.select(*keys, "n", F.round(F.coalesce("_mean", zero), 2).alias("mean"),
                      F.round(F.coalesce("_med", zero), 2).alias("median"),
                      F.round(F.coalesce("_min", zero), 2).alias("min"),
                      F.round(F.coalesce("_max", zero), 2).alias("max"),
                      F.round(F.coalesce(percent_of(F.col("_mean"), F.col("_p")), zero), 1).alias("mean_pct"))


def rubric_health(scored: DataFrame, rubric: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """Item analysis per criterion; correlation is with the rest of the score."""
    whole = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    cells = (scored.select(*keys, whole.alias("_all"), F.explode(scores).alias("criterion_id", "_v"))
             .select(*keys, "criterion_id", F.coalesce("_v", F.lit(0.0)).alias("v"),
                     (F.col("_all") - F.coalesce("_v", F.lit(0.0))).alias("rest")))
    # the few rows of the rubric are looked up, so that no task sorts its scores
    joined = cells.join(rubric.where("points > 0").select(*keys, "criterion_id", "label", "points").hint("shuffle_hash"),
                        [*keys, "criterion_id"])
    v, top = F.col("v"), F.col("points")
    agg = joined.groupBy(*keys, "criterion_id", "label", "points").agg(
        F.count("v").alias("n"), F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_sx"),
        F.stddev_samp("rest").alias("_sy"), F.covar_samp("v", "rest").alias("_cov"),
        F.min("v").alias("_min"), F.max("v").alias("_max"),
        F.count_if(v >= CEILING * top).alias("at_ceiling"), F.count_if(v <= FLOOR * top).alias("at_floor"))
    spread = F.coalesce("_sx", F.lit(0.0))
    r = F.when(F.col("n") >= 3, F.round(F.try_divide(F.col("_cov"), F.col("_sx") * F.col("_sy")), 3))
    out = agg.select(
        *keys, "criterion_id", "label", "points", "n", F.round("_mean", 2).alias("mean"),
        F.round(100.0 * F.col("_mean") / top, 1).alias("mean_pct"), F.round(spread, 2).alias("spread"),
        F.round(100.0 * spread / top, 1).alias("spread_pct"), F.round("_min", 2).alias("min"),
        F.round("_max", 2).alias("max"), "at_ceiling", "at_floor", r.alias("r_with_rest"),
        (F.col("_mean") / top).alias("_share"), (spread / top).alias("_spread"))
    everyone = F.col("at_ceiling") == F.col("n")
    findings = F.array_compact(F.array(
        F.when(everyone, "ceiling").when((F.col("_spread") <= LOW_SPREAD) & (F.col("n") > 2), "no_spread"),
        F.when(F.col("_share") <= FLOOR, "floor").when(F.col("_share") < WEAK_MEAN, "weak"),
        F.when(F.col("r_with_rest").isNotNull() & (F.col("n") >= MIN_N_FOR_R)
               & (F.abs("r_with_rest") < WEAK_LINK) & ~everyone, "weak_link")))
    return out.withColumn("findings", findings).drop("_share", "_spread")


def normal_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9 ]", ""))


def course_patterns(health: DataFrame, course: str, min_rows: int = MIN_POOL) -> DataFrame:
    """Criteria that come out weak in two or more assignments of a course, matched on wording."""
    rows = health.where(F.col("n") >= min_rows).withColumn("label", normal_label(F.col("label"))).where("label <> ''")
    weak = F.col("mean_pct") < 100 * WEAK_MEAN
    return (rows.groupBy(course, "label")
            .agg(F.count(F.lit(1)).alias("times_seen"), F.count_if(weak).alias("times_weak"),
                 exact_mean(F.when(weak, F.col("mean_pct")), 1).alias("mean_pct"))
            .where("times_seen >= 2 AND times_weak >= 2")
            .select(course, "label", "times_seen", "times_weak", "mean_pct"))


def unscored_counts(entries: DataFrame, keys: list[str], status: Column, scored: Column,
                    has_entry: Column) -> DataFrame:
    """Students with no score, by why: nothing turned in, nothing readable, not graded yet."""
    rows = entries.select(*keys, F.when(scored, "scored").when(status == "unsubmitted", "no_submission")
                          .when(has_entry, "nothing_readable").otherwise("not_graded_yet").alias("_r"))
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("_r") == n).alias(n) for n in
                                     ("no_submission", "nothing_readable", "not_graded_yet")])


def class_aggregate(entries: DataFrame, keys: list[str], value: Column, scored: Column, status: Column,
                    include_missing: bool = False, criteria: dict[str, Column] | None = None) -> DataFrame:
    """Class size and score figures per assignment; groups with under three in the pool drop out."""
    turned_in = F.coalesce(status, F.lit("")) != "unsubmitted"
    pool = scored if include_missing else scored & turned_in
    cells = {c: F.when(pool, F.coalesce(col, F.lit(0.0))) for c, col in (criteria or {}).items()}
    rows = entries.select(*keys, F.when(pool, value).alias("_v"), turned_in.alias("_in"),
                          (pool & turned_in).alias("_done"), *[col.alias(f"_c_{c}") for c, col in cells.items()])
    per_cell = [a for c in cells for a in (F.round(F.avg(f"_c_{c}"), 2).alias(f"{c}_mean"),
                                           F.min(f"_c_{c}").alias(f"{c}_min"), F.max(f"_c_{c}").alias(f"{c}_max"))]
    return (rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("enrolled"), F.count_if("_in").alias("submitted"),
        F.count_if(~F.col("_in")).alias("missing"), (F.count_if("_in") - F.count_if("_done")).alias("ungraded"),
        F.count("_v").alias("pool"), F.round(F.avg("_v"), 2).alias("mean"), F.round(F.median("_v"), 2).alias("median"),
        F.min("_v").alias("low"), F.max("_v").alias("high"), *per_cell)
        .where(F.col("pool") >= MIN_POOL))


def curve_plan(entries: DataFrame, keys: list[str], kind: str, before: Column, top: Column,
               amount: float = 0.0, target: float | None = None, taking_part: Column | None = None) -> DataFrame:
    """Per student: before, after and delta of a curve that never lowers and never passes ``top``.

    ``before`` is the present standing (curves included). Only ``target_mean`` and ``to_top``
    need the group: its figures come from a grouped aggregate joined back, not from a window
    that would hold a whole assignment in one task.
    """
    part = F.lit(True) if taking_part is None else taking_part
    rows = entries.where(part).withColumn("_b", before).withColumn("_t", top)
    b, t = F.col("_b"), F.col("_t")
    if kind in ("target_mean", "floor") and target is None:
        raise ValueError(f"the {kind} curve needs a target percent")
    goal = F.lit((target or 0.0) / 100.0) * t
    if kind in ("target_mean", "to_top"):
        group = rows.groupBy(*keys).agg(F.max("_b").alias("_gmax"), exact_mean(F.col("_b")).alias("_gmean"))
        rows = rows.join(group, keys)
    raw = {
        "flat": b + amount,
        "scale": b * (1.0 + amount / 100.0),
        "target_mean": b + (goal - F.col("_gmean")),
        "to_top": b + F.greatest(F.lit(0.0), t - F.col("_gmax")),
        "sqrt": F.when(t > 0, F.sqrt(F.greatest(F.lit(0.0), b / t)) * t).otherwise(b),
        "floor": F.greatest(b, goal),
    }[kind]
    rows = rows.withColumn("_raw", raw)
    after = F.least(F.greatest(F.col("_raw"), b), t)
    own = [c for c in entries.columns if c not in keys]
    return rows.select(*keys, *own, F.round("_b", 2).alias("before"), F.round(after, 2).alias("after"),
                       F.round(after - b, 2).alias("delta"), (F.col("_raw") < b).alias("kept_from_lowering"),
                       (F.col("_raw") > t).alias("capped"))


def curve_effect(plan: DataFrame, keys: list[str], possible: Column) -> DataFrame:
    """Before/after statistics of a curve plan per group."""
    rows = plan.select(*keys, "before", "after", "delta", "kept_from_lowering", "capped", possible.alias("_p"))
    return (rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if(F.col("delta") != 0).alias("n_changed"),
        F.count_if("kept_from_lowering").alias("n_lowered_blocked"), F.count_if("capped").alias("n_capped"),
        F.max("delta").alias("biggest_gain"), exact_mean(F.col("delta"), 2).alias("mean_gain"),
        exact_mean(F.col("before"), 2).alias("mean_before"), exact_mean(F.col("after"), 2).alias("mean_after"),
        F.round(exact_median(F.col("before")), 2).alias("median_before"), F.round(exact_median(F.col("after")), 2).alias("median_after"),
        F.round(F.try_divide(F.sum(F.col("after").cast("decimal(18,2)")) * 100,
                             F.count(F.lit(1)) * F.max(F.col("_p").cast("decimal(10,2)"))), 1).cast("double")
        .alias("mean_pct_after")))


def stack_curve(flat: Column, by_criterion: Column, scope: str, delta: Column) -> tuple[Column, Column]:
    """Add a curve step to the curve already there; steps build on each other."""
    if scope == "total":
        return F.round(F.coalesce(flat, F.lit(0.0)) + delta, 4), by_criterion
    old = F.coalesce(F.try_element_at(by_criterion, F.lit(scope)), F.lit(0.0))
    rest = F.map_filter(by_criterion, lambda k, _v: k != scope)
    return flat, F.map_concat(rest, F.create_map(F.lit(scope), F.round(old + delta, 4)))


def curve_pool(plan: DataFrame, rest: DataFrame, keys: list[str], scope: str, total: Callable[[Column, Column], Column],
               possible: Column, flat: str = "curve_flat", by_criterion: str = "curve_by") -> DataFrame:
    """What a curve does to the whole graded pool: figures and letters before and after, of the plan's students and the ``rest``.

    The plan's steps are stacked on the curves already there (``stack_curve``); ``total(flat, by_criterion)`` is a student's final total
    under a curve. A plan keeps the entries' columns, so both parts are one table without a join.
    """
    rows = plan.select(*rest.columns, "delta").unionByName(rest.withColumn("delta", F.lit(0.0)))
    new_flat, new_by = stack_curve(F.col(flat), F.col(by_criterion), scope, F.col("delta"))
    rows = rows.withColumns({"_was": total(F.col(flat), F.col(by_criterion)), "_flat": new_flat, "_by": new_by})
    rows = rows.withColumn("_now", F.when(F.col("delta") == 0, F.col("_was")).otherwise(total(F.col("_flat"), F.col("_by")))).withColumn("_p", possible)
    names = [n for n, _ in LETTER_SCALE] + [FAIL_LETTER]
    figures = []
    for side, value in (("before", F.col("_was")), ("after", F.col("_now"))):
        mark = letter(percent_of(value, F.col("_p")))
        figures += [exact_mean(value, 2).alias(f"mean_{side}"), F.round(exact_median(value), 2).alias(f"median_{side}"),
                    F.array(*[F.count_if(mark == n) for n in names]).alias(f"letters_{side}")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") != 0).alias("n_changed"), *figures)


def weak_row_evidence(scored: DataFrame, health: DataFrame, keys: list[str], user: str, scores: str = "scores",
                      criteria: int = 3, students: int = 6) -> DataFrame:
    """The lowest scorers of each assignment's weakest criteria, candidates for their notes."""
    weakest = W.partitionBy(*keys).orderBy("mean_pct", "criterion_id")
    weak = (health.where(F.col("mean_pct") < 100 * WEAK_MEAN)
            .withColumn("weak_rank", F.row_number().over(weakest)).where(F.col("weak_rank") <= criteria)
            .select(*keys, "criterion_id", "weak_rank", "mean_pct"))
    cells = scored.select(*keys, user, F.explode(scores).alias("criterion_id", "scored"))
    lowest = W.partitionBy(*keys, "criterion_id").orderBy("scored", user)
    return (cells.join(weak.hint("shuffle_hash"), [*keys, "criterion_id"])
            .withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= students)
            .select(*keys, "weak_rank", "criterion_id", "mean_pct", "place", user, "scored"))


def flag_frequency(scored: DataFrame, keys: list[str], flags: str = "flags", top: int = 8) -> DataFrame:
    counts = scored.select(*keys, F.explode(flags).alias("flag")).groupBy(*keys, "flag").agg(
        F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "flag") if keys else None
    if order is None:
        return counts.orderBy(F.desc("n"), "flag").limit(top)
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def missing_work(enrolled: DataFrame, submissions: DataFrame, keys: list[str]) -> DataFrame:
    """Who has nothing turned in and is not excused, with the score already on the books."""
    done = submissions.where("coalesce(excused, false) OR submitted_at IS NOT NULL").select(*keys).distinct()
    open_rows = submissions.where("NOT coalesce(excused, false) AND submitted_at IS NULL").select(*keys, "score")
    return (enrolled.join(done, keys, "left_anti").join(open_rows, keys, "left")
            .withColumn("graded", F.col("score").isNotNull()))


def complete_submissions(enrolled: DataFrame, submissions: DataFrame, keys: list[str]) -> DataFrame:
    """Every enrolled student gets a row, submission or not."""
    return enrolled.join(submissions, keys, "left").select(
        *enrolled.columns, F.coalesce("status", F.lit("unsubmitted")).alias("status"), "submitted_at",
        F.coalesce("attempt", F.lit(0)).alias("attempt"), F.coalesce("words", F.lit(0)).alias("words"))


def grade_export(entries: DataFrame, criteria: list[tuple[str, str]], scored: Column, earned: Column,
                 total: Column, possible: Column) -> DataFrame:
    """A wide grade sheet: one row per student, one column per criterion; with ``name`` in the entries also that and the row's place by name."""
    rows = entries.withColumn("_s", scored).withColumn("_e", earned).withColumn("_t", total).withColumn("_p", possible)
    when = lambda c: F.when(F.col("_s"), c)
    pct = F.round(percent_of(F.col("_t"), F.col("_p")), 1)
    change = F.round(F.col("_t") - F.col("_e"), 2)
    named = ["name", F.row_number().over(W.partitionBy("assignment_id").orderBy(F.lower("name"), "user_id", "_t")).alias("place")] if "name" in entries.columns else []
    return rows.select(
        "assignment_id", "user_id", *named, when(F.col("_e")).alias("earned"), when(F.when(change != 0, change)).alias("curve"),
        when(F.col("_t")).alias("total"), F.col("_p").alias("points_possible"), when(pct).alias("percent"),
        when(letter(pct)).alias("letter"), "source", F.array_join("flags", "; ").alias("flags"),
        *[F.col("scores")[cid].alias(name) for cid, name in criteria],
        F.regexp_replace(F.coalesce("comment", F.lit("")), "\n", " ").alias("comment"))
