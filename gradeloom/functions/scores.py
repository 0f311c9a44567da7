"""Column arithmetic on one draft grade: what counts, what was earned, what is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade sources that carry no score, and the default letter scale.
UNSCORED_SOURCES = ("auto-skip", "no-submission")
PLACEHOLDER_SOURCES = ("auto-skip", "no-submission", "error")
LETTER_SCALE = (("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0))
FAIL_LETTER = "F"
SAME_SCORE = 0.005


def is_scored(total: Column, source: Column) -> Column:
    """A missing submission is not a zero: it has no score at all."""
    return total.isNotNull() & ~F.coalesce(source, F.lit("")).isin(*UNSCORED_SOURCES)


def same_score(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < SAME_SCORE, F.lit(False))


def letter(percent: Column, scale=LETTER_SCALE) -> Column:
    out = F.when(percent.isNull(), "")
    for name, cutoff in sorted(scale, key=lambda row: -row[1]):
        out = out.when(percent >= cutoff, name)
    return out.otherwise(FAIL_LETTER)


def percent_of(value: Column, possible: Column) -> Column:
    return F.when(possible > 0, 100.0 * value / possible).otherwise(0.0)


def _rubric_sum(rubric: Column, cell) -> Column:
    """Sum ``cell(criterion, top)`` over a rubric held as map<criterion, points>."""
    return F.aggregate(F.map_entries(rubric), F.lit(0.0), lambda acc, e: acc + cell(e["key"], e["value"]))


def _cell(cells: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(cells, key), F.lit(0.0))


def earned_total(scores: Column, total: Column, total_only: Column, rubric: Column) -> Column:
    """Rubric cells added up, or the typed total where there are no cells to add."""
    by_rubric = (F.size(rubric) > 0) & ~F.coalesce(total_only, F.lit(False))
    return F.round(F.when(by_rubric, _rubric_sum(rubric, lambda k, _top: _cell(scores, k)))
                   .otherwise(F.coalesce(total, F.lit(0.0))), 2)


def final_total(scores: Column, total: Column, total_only: Column, rubric: Column, possible: Column,
                flat: Column | None = None, by_criterion: Column | None = None,
                dock: Column | None = None) -> Column:
    """Earned, plus the curve (where there is one, each criterion kept within 0 and its points), minus the late dock."""
    base = earned_total(scores, total, total_only, rubric)
    if flat is not None or by_criterion is not None:
        flat = F.coalesce(flat, F.lit(0.0)) if flat is not None else F.lit(0.0)
        if by_criterion is not None:
            by_rubric = (F.size(rubric) > 0) & ~F.coalesce(total_only, F.lit(False))
            cells = _rubric_sum(rubric, lambda k, top: F.greatest(
                F.lit(0.0), F.least(_cell(scores, k) + _cell(by_criterion, k), top)))
            curved = (flat != 0) | (F.size(F.map_keys(by_criterion)) > 0)
            base = F.when(by_rubric & F.coalesce(curved, F.lit(False)), cells).otherwise(base)
        base = base + flat
    shown = F.greatest(F.lit(0.0), base - (dock if dock is not None else F.lit(0.0)))
    return F.round(F.when(possible > 0, F.least(shown, possible)).otherwise(shown), 2)


def late_units(seconds: Column, grace_hours: Column, interval: Column) -> Column:
    """Started days or hours of lateness beyond the grace period."""
    after = seconds.cast("long") - (F.coalesce(grace_hours, F.lit(0.0)) * 3600).cast("long")
    step = F.when(interval == "hour", 3600).otherwise(86400)
    return F.when(after > 0, F.ceil(after / step)).otherwise(0).cast("long")


def late_dock(earned: Column, kind: Column, percent: Column, units: Column, floor_percent: Column) -> Column:
    """Points off for an applied penalty of this kind."""
    earned = F.greatest(F.lit(0.0), earned)
    share = F.when(kind == "flat_percent", percent).when(
        kind.isin("percent_per_day", "percent_per_hour", "lms"), percent * F.greatest(units, F.lit(0)))
    share = F.least(F.greatest(share, F.lit(0.0)), F.greatest(F.lit(0.0), 100.0 - F.coalesce(floor_percent, F.lit(0.0))))
    return F.round(F.when(kind == "none_accepted", earned).when(share.isNotNull(), earned * share / 100.0)
                   .otherwise(0.0), 2)


def late_penalty(late: Column, seconds: Column, total: Column, policy: Column) -> Column:
    """Struct(kind, units, applied, past_window, points, note) for one graded submission.

    ``policy`` is a struct(kind, percent, interval, grace_hours, floor_percent, max_days, lms_applies).
    Null where the work was on time or has no total.
    """
    units = late_units(seconds, policy["grace_hours"], policy["interval"])
    per_step = policy["kind"].isin("percent_per_day", "percent_per_hour")
    lms = F.coalesce(policy["lms_applies"], F.lit(False))
    window = policy["max_days"] * F.when(policy["kind"] == "percent_per_hour", 24).otherwise(1)
    past = ~lms & F.coalesce(per_step & (units > window), F.lit(False))
    none = past | (policy["kind"] == "none_accepted")
    docks = ~lms & (none | ((per_step | (policy["kind"] == "flat_percent")) & (units > 0)))
    kind = F.when(lms, "lms").when(none, "none_accepted").otherwise(policy["kind"])
    points = F.when(docks, late_dock(total, kind, policy["percent"], units, policy["floor_percent"]))
    note = F.when(docks & none, "late penalty: not accepted").when(docks, "late penalty applied")
    return F.when(F.coalesce(late, F.lit(False)) & total.isNotNull(), F.struct(
        kind.alias("kind"), units.alias("units"), docks.alias("applied"), past.alias("past_window"),
        points.alias("points"), note.alias("flag")))
