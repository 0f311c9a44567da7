"""Merges of two copies of the same keyed data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.functions.scores import PLACEHOLDER_SOURCES, same_score

def three_way_merge(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Draft grades against the gradebook, with the last agreed score as the baseline.

    ``local``: total (final), source, synced_score, in_conflict. ``remote``: score, status,
    needs_written. One full outer join; the outcome ladder is one expression.

    Where ``remote`` has ``cells`` (map criterion to points) and ``local`` ``scores`` and ``total_only``, they are merged too: an adopted
    grade takes the cells of criteria in ``remote.criteria`` (all, if there are none) when they add up to its score; else it has no cells
    and is marked ``total_only``, for then its total alone is known.
    """
    with_cells = "cells" in remote.columns
    mine = ["total", "source", "synced_score", "in_conflict", *(["scores", "total_only"] if with_cells else [])]
    theirs = ["score", "status", "needs_written", *(["cells", "criteria"] if with_cells else [])]
    j = local.select(*keys, *mine, F.lit(True).alias("_l")).join(remote.select(*keys, *theirs, F.lit(True).alias("_r")), keys, "full_outer")
    c = F.col
    placeholder = c("_l").isNull() | c("total").isNull() | F.coalesce(c("source").isin(*PLACEHOLDER_SOURCES), F.lit(False))
    base_known = c("synced_score").isNotNull()
    local_moved = ~base_known | ~same_score(c("total"), c("synced_score"))
    remote_moved = ~base_known | ~same_score(c("score"), c("synced_score"))
    outcome = (F.when(c("_r").isNull(), "untouched")
               .when(c("score").isNull(), F.when(F.coalesce("in_conflict", F.lit(False)), "cleared").otherwise("untouched"))
               .when(placeholder & (c("status") == "unsubmitted"), "unsubmitted")
               .when(placeholder & F.coalesce("needs_written", F.lit(False)), "quiz_open")
               .when(placeholder, "adopted").when(same_score(c("total"), c("score")), "in_sync")
               .when(remote_moved & ~local_moved, "adopted").when(local_moved & ~remote_moved, "kept").otherwise("conflict"))
    j = j.withColumn("outcome", outcome)
    takes = c("outcome") == "adopted"
    agrees = takes | (c("outcome") == "in_sync")
    cells = []
    if with_cells:
        known = F.map_filter(F.coalesce("cells", F.create_map().cast("map<string,double>")), lambda k, _v: (F.coalesce(F.size("criteria"), F.lit(0)) <= 0)
                             | F.array_contains("criteria", k))
        adds_up = (F.size(known) > 0) & same_score(F.aggregate(F.map_values(known), F.lit(0.0), lambda a, v: a + v), F.round("score", 2))
        none = F.map_filter(known, lambda _k, _v: F.lit(False))
        cells = [F.when(takes, F.when(adds_up, known).otherwise(none)).otherwise(c("scores")).alias("scores"),
                 F.when(takes, ~adds_up).otherwise(c("total_only")).alias("total_only")]
    return j.select(
        *keys, "outcome", *cells, F.when(takes, F.round("score", 2)).otherwise(c("total")).alias("total"),
        F.when(takes, "lms").otherwise(c("source")).alias("source"),
        F.when(agrees, F.round("score", 2)).otherwise(c("synced_score")).alias("synced_score"),
        F.when(c("outcome") == "conflict", F.struct(c("score").alias("remote_score"), c("total").alias("local_score"))).alias("conflict"))


def resolve_conflicts(merged: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """Settle conflicts: ``theirs`` takes the gradebook's score, ``mine`` accepts it as the baseline."""
    rows = merged.join(choices.select(*keys, "choice"), keys, "left")
    open_ = F.col("conflict").isNotNull()
    theirs, mine = open_ & (F.col("choice") == "theirs"), open_ & (F.col("choice") == "mine")
    remote = F.round("conflict.remote_score", 2)
    return rows.select(
        *keys, F.when(theirs, remote).otherwise(F.col("total")).alias("total"),
        F.when(theirs, "lms").otherwise(F.col("source")).alias("source"),
        F.when(theirs | mine, remote).otherwise(F.col("synced_score")).alias("synced_score"),
        F.coalesce(theirs | mine, F.lit(False)).alias("settled"), (open_ & F.col("choice").isNull()).alias("open"))


def lww_merge(left: DataFrame, right: DataFrame, keys: list[str], stamp: str = "updated", tie: str = "left") -> DataFrame:
    """Last writer wins per key; clears are rows too. ``tie`` says which side an equal stamp keeps."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    sa, sb = F.col(f"_a.{stamp}"), F.col(f"_b.{stamp}")
    keeps = sa >= sb if tie == "left" else sa > sb
    j = a.join(b, keys, "full_outer")
    from_left = F.col("_b").isNull() | (F.col("_a").isNotNull() & F.coalesce(keeps, F.lit(False)))
    return j.select(*keys, F.when(from_left, F.col("_a")).otherwise(F.col("_b")).alias("_w"),
                    F.when(from_left, "left").otherwise("right").alias("side")).select(*keys, "_w.*", "side")


def merge_conflicts(left: DataFrame, right: DataFrame, keys: list[str], grant: list[str], stamp: str = "updated") -> DataFrame:
    """Keys whose two copies hold different grants, with the copy that wins and the one that loses."""
    cols = [*grant, stamp]
    j = left.select(*keys, F.struct(*cols).alias("_a")).join(right.select(*keys, F.struct(*cols).alias("_b")), keys)
    differ = F.struct(*[F.col(f"_a.{g}") for g in grant]) != F.struct(*[F.col(f"_b.{g}") for g in grant])
    right_wins = F.col(f"_b.{stamp}") >= F.col(f"_a.{stamp}")
    return j.where(differ).select(*keys, F.when(right_wins, F.col("_b")).otherwise(F.col("_a")).alias("kept"),
                                  F.when(right_wins, F.col("_a")).otherwise(F.col("_b")).alias("other"))


def history_union(saved: DataFrame, local: DataFrame, person: str) -> DataFrame:
    """Event histories joined by content, the later copy kept, each with its place per person, newest first.

    Every event is returned; a report that lists only the newest applies its limit to ``place``.
    """
    content = [person, "at", "kind", "course_id", "assignment_id", "summary"]
    both = saved.withColumn("_src", F.lit(0)).unionByName(local.withColumn("_src", F.lit(1)))
    rest = [c for c in saved.columns if c not in content]
    uniq = (both.groupBy(*content).agg(F.max_by(F.struct(*rest), F.col("_src")).alias("_x")).select(*content, "_x.*") if rest
            else both.select(*content).distinct())
    order = W.partitionBy(person).orderBy(F.desc("at"), "kind", "course_id", "assignment_id", "summary")
    return uniq.withColumn("place", F.row_number().over(order))


def replica_decision(local: DataFrame, remote: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """Push, pull, keep, diverged or empty for each replicated key.

    ``local``: key, sha256 (null where there is nothing to keep). ``remote``: key, rev, sha256.
    ``sidecar``: key, rev, sha256 as last sent.
    """
    j = (local.select(key, F.col("sha256").alias("here")).join(
        remote.select(key, F.col("rev").alias("r_rev"), F.col("sha256").alias("there"), F.lit(True).alias("_r")), key, "full_outer")
        .join(sidecar.select(key, F.col("rev").alias("s_rev"), F.col("sha256").alias("sent")), key, "left"))
    c = F.col
    sent_rev, remote_rev = F.coalesce("s_rev", F.lit(0)), F.coalesce("r_rev", F.lit(0))
    dirty = F.coalesce(c("here") != c("sent"), F.lit(False))
    newer = remote_rev > sent_rev
    action = (F.when(c("_r").isNull(), F.when(c("here").isNull(), "empty").otherwise("push"))
              .when(c("here").isNull(), "pull").when(c("here") == c("there"), "keep")
              .when(dirty & newer & (c("there") != F.coalesce("sent", F.lit(""))), "diverged")
              .when(newer & ~dirty, "pull").otherwise("push"))
    return j.select(key, action.alias("action"), sent_rev.alias("local_rev"), remote_rev.alias("remote_rev"))


def unsent(manifest: DataFrame, sent: DataFrame) -> DataFrame:
    """Files whose digest differs from what was last sent."""
    return manifest.join(sent.select("name", "sha256"), ["name", "sha256"], "left_anti")


def priority_merge(left: DataFrame, right: DataFrame, keys: list[str], value: str = "text", source: str = "source",
                   rank: tuple[str, ...] = ("human", "model")) -> DataFrame:
    """Per key the text of the better source; among equals the newer side (right) wins."""
    order = F.lit(len(rank))
    for i, name in reversed(list(enumerate(rank))):
        order = F.when(F.col(source) == name, i).otherwise(order)
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    best = F.max_by(F.struct(value, source), F.struct((-order).alias("o"), F.col("_side").alias("s")))
    return both.groupBy(*keys).agg(best.alias("_w")).select(*keys, "_w.*")


def check_report(items: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Why a verify report does not cover an item: not in it, changed since, or failing."""
    j = items.select(key, F.sha2("html", 256).alias("now")).join(report.select(key, "ok", "sha256", F.lit(True).alias("_in")), key, "left")
    problem = (F.when(F.col("_in").isNull(), "not in the report").when(F.col("now") != F.col("sha256"), "changed since verify")
               .when(~F.col("ok"), "failing"))
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def change_plan(items: DataFrame, key: str, kinds: list[str] | None = None, min_body: int = 20,
                excluded: DataFrame | None = None) -> DataFrame:
    """Bodies to write and bodies left alone, with the reason. ``items``: key, kind, original, styled."""
    rows = items
    out = F.lit(False)
    if excluded is not None:
        rows = rows.join(excluded.select(key).distinct().withColumn("_out", F.lit(True)), key, "left")
        out = F.coalesce("_out", F.lit(False))
    other = ~F.col("kind").isin(*kinds) if kinds else F.lit(False)
    why = (F.when(F.col("styled").isNull(), "empty original").when(other, "kind not selected").when(out, "excluded")
           .when(F.length(F.trim("styled")) < min_body, "styled body is empty").when(F.col("styled") == F.col("original"), "identical"))
    return rows.select(key, "kind", why.alias("skip"), F.length("original").alias("from_chars"), F.length("styled").alias("to_chars"))
