"""Desired against existing: upserts, keep lists, settings, and referential checks of a course build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts of an alignment, kinds of build entries and where module items point.
VERDICTS = ("assessed", "partially-assessed", "not-assessed", "ungraded-only")
ITEM_TARGETS = {"Page": "pages", "Assignment": "assignments", "Discussion": "discussions", "Quiz": "quizzes"}
SUBHEADER = "SubHeader"
SLUG = r"^[a-z0-9][a-z0-9-]*$"
LEAVE_ALONE = ("settings",)
OPERATIONS = ("set_dates", "publish", "unpublish", "announce")


def _findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def outcome_alignment_check(leaves: DataFrame, items: DataFrame, alignment: DataFrame, course: str = "course_id") -> DataFrame:
    """Findings over an alignment: omitted, invented and repeated outcomes, verdicts outside the set,
    evidence that is not in the course, coverage without evidence. ``alignment``: course, slo,
    verdict, evidence, rationale, suggestion."""
    ids = leaves.select(course, F.col("leaf_id").alias("slo"))
    rows = alignment.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    say = lambda df, level, rule: df.select(course, "slo", F.lit(level).alias("level"), F.lit(rule).alias("rule"))
    mapped = rows.select(course, "slo")
    own = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for cond, level, rule in (
        (~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "error", "unknown verdict"),
        (F.col("verdict").isin("assessed", "partially-assessed") & (F.size("evidence") == 0), "error", "covered without evidence"),
        ((F.col("verdict") == "not-assessed") & (F.size("evidence") > 0), "warning", "evidence on a gap"),
        (F.col("verdict").isin("not-assessed", "ungraded-only") & (F.trim(F.coalesce("suggestion", F.lit(""))) == ""), "warning", "gap without a suggestion"),
        (F.trim(F.coalesce("rationale", F.lit(""))) == "", "warning", "no reason given"))]))
    cited = rows.select(course, "slo", F.explode(F.array_distinct("evidence")).alias("item_id"))
    stray = cited.join(items.select(course, "item_id"), [course, "item_id"], "left_anti").select(course, "slo").distinct()
    twice = mapped.groupBy(course, "slo").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _findings([
        say(ids.join(mapped, [course, "slo"], "left_anti"), "error", "omitted"),
        say(mapped.join(ids, [course, "slo"], "left_anti"), "error", "invented"), say(twice, "error", "duplicate"),
        rows.select(course, "slo", F.inline(own)), say(stray, "error", "stray evidence")])


def alignment_coverage(alignment: DataFrame, course: str = "course_id") -> DataFrame:
    counts = alignment.groupBy(course).agg(F.count(F.lit(1)).alias("mapped"), *[
        F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in VERDICTS])
    return counts.withColumns({
        "gaps": F.col("not_assessed") + F.col("ungraded_only"),
        "coverage": F.round(100.0 * (F.col("assessed") + 0.5 * F.col("partially_assessed")) / F.col("mapped"), 1)})


def content_inventory(kinds: dict[str, DataFrame], course: str = "course_id") -> DataFrame:
    """Evidence items of every kind as one relation. Each input: course, item_id, name, points, graded."""
    return _findings([df.select(course, F.concat(F.lit(f"{k}-"), F.col("item_id").cast("string")).alias("item_id"), F.lit(k).alias("type"),
                                "name", F.col("points").cast("double").alias("points"), "graded") for k, df in kinds.items()])


def inventory_counts(inventory: DataFrame, course: str = "course_id") -> DataFrame:
    return inventory.groupBy(course, "type").agg(F.count(F.lit(1)).alias("items"), F.count_if("graded").alias("graded"))


def slo_leaves(lines: DataFrame, course: str = "course_code", block: str = "block_id", pos: str = "pos", text: str = "line") -> DataFrame:
    """Outline lines of course blocks to leaf outcomes with dotted ids; the richest block of a code wins.

    Markers are ``1.``, ``a.`` and ``(1)``; other lines continue the marker before them. Ids are
    carried down with windows over one block, which is one course's outline.
    """
    from pyspark.sql import Window as W
    over = W.partitionBy(course, block).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    t = F.regexp_replace(text, " ", " ")
    rx = {1: r"^\s*(\d{1,2})\.(?:\s+(.*))?$", 2: r"^\s*([a-z])\.(?:\s+(.*))?$", 3: r"^\s*\((\d{1,2})\)(?:\s+(.*))?$"}
    level = F.when(t.rlike(rx[1]), 1).when(t.rlike(rx[2]), 2).when(t.rlike(rx[3]), 3)
    rows = lines.where((F.trim(t) != "") & ~t.rlike(r"(?i)^\s*The student will\b")).select(course, block, pos, t.alias("t"), level.alias("raw"))
    # A level counts only under its parent; otherwise the line continues the one before it.
    seen1 = F.max(F.when(F.col("raw") == 1, F.col(pos))).over(over)
    seen2 = F.max(F.when(F.col("raw") == 2, F.col(pos))).over(over)
    ok = (F.col("raw") == 1) | ((F.col("raw") == 2) & seen1.isNotNull()) | ((F.col("raw") == 3) & (seen2 > seen1))
    rows = rows.withColumn("level", F.when(ok, F.col("raw")))
    at = lambda n: F.last(F.when(F.col("level") == n, F.col(pos)), ignorenulls=True).over(over)
    mark = lambda n: F.last(F.when(F.col("level") == n, F.regexp_extract("t", rx[n], 1)), ignorenulls=True).over(over)
    rows = rows.withColumns({f"p{n}": at(n) for n in (1, 2, 3)}).withColumns({f"m{n}": mark(n) for n in (1, 2, 3)})
    inside = lambda n: F.col(f"p{n}") > F.col(f"p{n - 1}")
    two, three = F.coalesce(inside(2), F.lit(False)), F.coalesce(inside(2) & inside(3), F.lit(False))
    ident = F.concat_ws(".", "m1", F.when(two, F.col("m2")), F.when(three, F.col("m3")))
    body = F.coalesce(*[F.when(F.col("level") == n, F.regexp_extract("t", rx[n], 2)) for n in (1, 2, 3)], F.when(F.length(F.trim("t")) > 1, F.trim("t")), F.lit(""))
    node = F.greatest("p1", F.when(two, F.col("p2")), F.when(three, F.col("p3")))
    parts = rows.where("p1 IS NOT NULL").select(course, block, pos, ident.alias("leaf_id"), node.alias("node"), F.trim(body).alias("body"))
    nodes = parts.groupBy(course, block, "node", "leaf_id").agg(F.array_sort(F.collect_list(F.struct(pos, "body"))).alias("b"))
    nodes = nodes.select(course, block, "node", "leaf_id", F.array_join(F.filter(F.transform("b", lambda x: x["body"]), lambda s: s != ""), " ").alias("text"))
    parents = nodes.where(F.col("leaf_id").contains(".")).select(course, block, F.regexp_extract("leaf_id", r"^(.*)\.[^.]+$", 1).alias("leaf_id")).distinct()
    leaves = nodes.join(parents, [course, block, "leaf_id"], "left_anti")
    best = leaves.groupBy(course, block).agg(F.count(F.lit(1)).alias("n")).groupBy(course).agg(F.min_by(block, F.struct((-F.col("n")).alias("n"), block)).alias(block))
    return leaves.join(best, [course, block], "left_semi").select(course, "leaf_id", "text")


def manifest_check(entries: DataFrame, module_items: DataFrame, build: str = "build_id") -> DataFrame:
    """Structural findings of a course build. ``entries``: build, kind, key, title, has_body, points,
    front_page. ``module_items``: build, module, type, target, title."""
    c = F.col
    label = F.coalesce(F.nullif(c("title"), F.lit("")), c("key"), F.lit("?"))
    row = lambda cond, rule: F.when(cond, F.lit(rule))
    own = F.array_compact(F.array(
        row(F.coalesce("title", F.lit("")) == "", "no title"), row((c("kind") != "pages") & (F.coalesce("key", F.lit("")) == ""), "no key"),
        row((c("kind") == "pages") & ~F.coalesce(c("key").rlike(SLUG), F.lit(False)), "bad slug"),
        row((c("kind") != "quizzes") & ~c("has_body"), "no body"), row(c("points") < 0, "negative points")))
    alone = entries.select(build, label.alias("where"), F.explode(own).alias("rule"))
    twice = entries.where("coalesce(key, '') <> ''").groupBy(build, "kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        build, c("key").alias("where"), F.lit("key twice").alias("rule"))
    fronts = entries.where("front_page").groupBy(build).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        build, F.lit("front page").alias("where"), F.lit("more than one front page").alias("rule"))
    known = c("type").isin(*ITEM_TARGETS, SUBHEADER)
    shape = module_items.select(build, c("module").alias("where"), F.when(~known, "unknown item type").when(
        (c("type") == SUBHEADER) & (F.coalesce("title", F.lit("")) == ""), "subheader without a title").alias("rule")).where("rule IS NOT NULL")
    kind = F.create_map(*[F.lit(x) for kv in ITEM_TARGETS.items() for x in kv])[c("type")]
    dangling = module_items.where(c("type").isin(*ITEM_TARGETS)).select(build, c("module").alias("where"), kind.alias("kind"), c("target").alias("key")).join(
        entries.select(build, "kind", "key"), [build, "kind", "key"], "left_anti").select(build, "where", F.lit("points nowhere").alias("rule"))
    return _findings([alone, twice, fronts, shape, dangling])


def upsert_plan(desired: DataFrame, existing: DataFrame, scope: str, key: str, skip: Column | None = None) -> DataFrame:
    """Create, update or skip per desired row, matched on the trimmed key."""
    have = existing.select(scope, F.trim(key).alias("_k"), F.col("id").alias("existing_id"))
    have = have.groupBy(scope, "_k").agg(F.max("existing_id").alias("existing_id"))
    rows = desired.withColumn("_k", F.trim(F.coalesce(key, F.lit("")))).join(have, [scope, "_k"], "left")
    reason = F.when(F.col("_k") == "", "no title")
    if skip is not None:
        reason = F.coalesce(reason, skip)
    return rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNotNull(), "skip").when(
        F.col("existing_id").isNotNull(), "update").otherwise("create")).drop("_k")


def rubric_warnings(criteria: Column) -> Column:
    """Per criterion struct(label, points, ratings array<double>): no ratings, or a top rating that is not the points."""
    return F.array_compact(F.transform(criteria, lambda c: F.when(F.coalesce(F.size(c["ratings"]), F.lit(0)) <= 0, F.concat(c["label"], F.lit(": no ratings")))
                                       .when(F.array_max(c["ratings"]) != c["points"], F.concat(c["label"], F.lit(": top rating is not the points")))))


def keep_list_plan(tabs: DataFrame, keep: list[str], course: str = "course_id") -> DataFrame:
    """Tabs of each course against one ordered list: keep, show, order, hide or leave.

    Positions count only the listed tabs a course really has.
    """
    wanted = keep if "home" in keep else ["home", *keep]
    rank = F.array_position(F.array(*[F.lit(k) for k in wanted]), F.col("tab_id"))
    rows = tabs.withColumn("_r", F.nullif(rank, F.lit(0)))
    have = rows.where("_r IS NOT NULL").groupBy(course).agg(F.array_sort(F.collect_set("_r")).alias("_have"))
    rows = rows.join(have, course, "left").withColumn("_pos", F.nullif(F.array_position("_have", F.col("_r")), F.lit(0)))
    hidden, listed = F.coalesce("hidden", F.lit(False)), F.col("_pos").isNotNull()
    action = (F.when(F.col("tab_id").isin(*LEAVE_ALONE), "leave").when(F.col("tab_id") == "home", "keep")
              .when(listed, F.when(hidden, "show").when(F.coalesce("position", F.lit(0)) != F.col("_pos"), "order").otherwise("keep"))
              .otherwise(F.when(hidden, "keep hidden").otherwise("hide")))
    return rows.select(course, "tab_id", "position", action.alias("action"),
                       F.when(F.col("tab_id") == "home", 1).when(listed & (action != "leave"), F.col("_pos").cast("int")).alias("position_after"))


def import_delta(source: DataFrame, dest: DataFrame, pairs: DataFrame, gate_kinds: list[str]) -> DataFrame:
    """What an import adds per kind, and whether it is refused. ``source`` / ``dest``: course_id, kind
    (one row per item). ``pairs``: import_id, source_id, dest_id, owned, force."""
    s = source.groupBy("course_id", "kind").agg(F.count(F.lit(1)).alias("adds"))
    d = dest.groupBy("course_id", "kind").agg(F.count(F.lit(1)).alias("has"))
    populated = d.where(F.col("kind").isin(*gate_kinds)).select(F.col("course_id").alias("dest_id")).distinct().withColumn("populated", F.lit(True))
    rows = pairs.join(s.withColumnRenamed("course_id", "source_id"), "source_id").join(
        d.withColumnRenamed("course_id", "dest_id"), ["dest_id", "kind"], "left").join(populated, "dest_id", "left")
    busy = F.coalesce("populated", F.lit(False))
    return rows.select("import_id", "kind", F.coalesce("has", F.lit(0)).alias("has"), "adds", (F.coalesce("has", F.lit(0)) + F.col("adds")).alias("after"),
                       (busy & ~F.coalesce("owned", F.lit(False)) & ~F.coalesce("force", F.lit(False))).alias("refused"))


def settings_diff(proposed: DataFrame, current: DataFrame, quiz: str, fields: list[str]) -> DataFrame:
    """Only real changes of known settings, one row per field, with the cross-field rules applied.

    ``proposed``: quiz, field, value. ``current``: quiz and one column per field, as strings. A field
    that would break a rule comes back with the reason in ``reject``.
    """
    wide = current.select(quiz, *[F.col(f).cast("string").alias(f) for f in fields])
    new = proposed.where(F.col("field").isin(*fields)).groupBy(quiz).pivot("field", fields).agg(F.max(F.struct(F.lit(1), F.col("value").alias("v"))))
    j = new.join(wide.select(quiz, *[F.col(f).alias(f"_c_{f}") for f in fields], F.lit(True).alias("_known")), quiz, "left")
    changed = lambda f: F.col(f).isNotNull() & ~F.nullif(F.col(f)["v"], F.lit("")).eqNullSafe(F.nullif(F.col(f"_c_{f}"), F.lit("")))
    after = lambda f: F.when(F.col(f).isNotNull(), F.col(f)["v"]).otherwise(F.col(f"_c_{f}"))
    stamp = lambda f: F.try_to_timestamp(after(f))
    opens_late = F.coalesce(stamp("unlock_at") > stamp("lock_at"), F.lit(False))
    due_late = F.coalesce(stamp("due_at") > stamp("lock_at"), F.lit(False))
    single = F.coalesce(after("one_question_at_a_time") == "true", F.lit(False))
    reject = {"unlock_at": F.when(opens_late, "opens after it closes"), "lock_at": F.when(opens_late, "opens after it closes"),
              "due_at": F.when(due_late, "due after it locks"), "cant_go_back": F.when((after("cant_go_back") == "true") & ~single, "needs one question at a time")}
    rows = F.array_compact(F.array(*[F.when(changed(f), F.struct(F.lit(f).alias("field"), F.col(f"_c_{f}").alias("from"), F.col(f)["v"].alias("to"),
                                                                 F.when(F.col("_known").isNull(), "no such quiz").otherwise(reject.get(f, F.lit(None)).cast("string"))
                                                                 .alias("reject"))) for f in fields]))
    known = j.select(quiz, F.inline(rows))
    other = proposed.where(~F.col("field").isin(*fields)).select(quiz, "field", F.lit(None).cast("string").alias("from"), F.col("value").alias("to"), F.lit("not a setting").alias("reject"))
    return known.unionByName(other)


def op_validate(ops: DataFrame, items: DataFrame, courses: DataFrame) -> DataFrame:
    """Proposed operations against the real schedule: the reason one is refused, or null.

    ``ops``: op_id, op, course_id, assignment_id, title, message, due_at. ``items``: course_id,
    assignment_id, published. ``courses``: course_id.
    """
    i = items.select("assignment_id", F.col("course_id").alias("i_course"), "published")
    k = courses.select("course_id").distinct().withColumn("_known", F.lit(True))
    rows = ops.join(i, "assignment_id", "left").join(k, "course_id", "left")
    c = F.col
    empty = lambda n: F.trim(F.coalesce(n, F.lit(""))) == ""
    why = (F.when(~F.coalesce(c("op").isin(*OPERATIONS), F.lit(False)), "unknown operation")
           .when(c("op") == "announce", F.when(c("_known").isNull(), "course is not yours").when(empty("title") | empty("message"), "no title or message"))
           .when(c("i_course").isNull(), "not in the schedule").when(c("course_id").isNotNull() & (c("course_id") != c("i_course")), "other course")
           .when(c("op") == "publish", F.when(c("published"), "already published")).when(c("op") == "unpublish", F.when(~c("published"), "already unpublished"))
           .when(F.try_to_timestamp(c("due_at")).isNull(), "no usable date"))
    return rows.select("op_id", "op", why.alias("reject"))


def slot_verify(entries: DataFrame, key: str, quiz_failures: DataFrame | None = None) -> DataFrame:
    """Per content slot ok, warn or fail. ``entries``: key, kind, title, html; pages need one h2 that
    matches the title."""
    from gradeloom.functions import html as h
    body = F.coalesce("html", F.lit(""))
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"&(amp|mdash|ndash|ldquo|rdquo);", ""), h.ANY_TAG, ""), "[^a-zA-Z0-9]", ""))
    hero, title = norm(F.regexp_extract(body, r"(?is)<h2[^>]*>(.*?)</h2>", 1)), norm(F.coalesce("title", F.lit("")))
    fits = (hero != "") & ((title == hero) | ((title != "") & hero.contains(title)) | title.contains(hero) | (title.contains("syllabus") & hero.contains("syllabus")))
    n, page = F.size(h.all_of(body, r"<h2\b")), F.col("kind") == "page"
    blank = F.regexp_replace(body, r"<[^>]+>|&nbsp;|\s", "") == ""
    rules = h.style_rules(F.col("html"), "authoring")
    styled = F.lit(False)
    for state in rules.values():
        styled = styled | F.coalesce(state == "fail", F.lit(False))
    basic = F.array_compact(F.array(F.when(blank, "empty body"), F.when(~blank & page & (n != 1), "not one h2"), F.when(~blank & page & (n == 1) & ~fits, "hero does not match"),
                                    F.when(~blank & body.rlike(r"[^\x00-\x7f]"), "non-ascii")))
    rows = entries.select(key, "kind", basic.alias("problems"), (page & ~blank & styled).alias("_style"), (~page & (n > 1)).alias("_warn"))
    rows = rows.withColumn("problems", F.when(F.col("_style") & (F.size("problems") == 0), F.array(F.lit("style"))).otherwise(F.col("problems")))
    if quiz_failures is not None:
        rows = rows.join(quiz_failures.select(key).distinct().withColumn("_q", F.lit(True)), key, "left").withColumn(
            "problems", F.when(F.col("_q"), F.concat("problems", F.array(F.lit("questions")))).otherwise(F.col("problems")))
    return rows.select(key, "kind", "problems", F.when(F.size("problems") > 0, "fail").when(F.col("_warn"), "warn").otherwise("ok").alias("state"))
