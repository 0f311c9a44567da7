"""Mixing sources to target weights by temperature, realised as budgeted block permutations. DataFrame functions only.

Weights are token shares raised to an exponent and normalised. The exponent is the largest one in [0, 1] whose entropy reaches
``entropy_share`` of the maximum, raised where needed until no source repeats more than ``max_repeats`` times; both are found by
bisection (six halvings per pass: the 63 inner points are evaluated together over the source table, of which one row comes back).

Each source then gets a budget of tokens: its weight times ``budget_tokens``, or, without a total, the smallest budgets in these
proportions that use every document of every source at least once. A source is cut into ``16 ** BLOCK_DIGITS`` blocks by the hash of
its rows. Epoch after epoch its blocks are permuted, and the documents within each block; the budget is filled in that order and a
document is taken when it still fits whole. ``slot`` (share of the source's budget before the document) merges the sources: sorted by
it, any stretch of the mixture holds them in their weights.

Running sums are per block (bounded share of a source) and over the blocks of one source and epoch (4096 rows), so a source with a
third of all rows is spread over thousands of keys.

Null source: a source of its own. Null or empty text: 0 tokens; taken with its block, in every epoch that reaches it. Sources without
tokens keep their documents once. Null ids and repeated rows: each row counts; equal rows follow one another. Extra columns stay;
columns named like the results (in any case) are replaced. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, stage

BLOCK_DIGITS = 3
PASSES, POINTS = 5, 64
ENTROPY_SHARE, MAX_REPEATS = 0.95, 2.0
RESULTS = ("n_tokens", "epoch", "start_tokens", "slot")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` as in_0, in_1, ..., so that no name of the caller meets the operator's own, with tokens and place."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
                .cast("binary"))
    carried = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]
    return docs.select(*carried, tokens(F.col("text")).alias("n_tokens"), source.alias("mix_source"), row.alias("mix_row"),
                       F.substring(row, 1, BLOCK_DIGITS).alias("mix_block"))


def exponent(sources: DataFrame, total: int, entropy_share: float, max_repeats: float, budget: int | None) -> float:
    """The temperature exponent for a table of sources with ``t`` tokens each."""
    live = sources.where("t > 0").select((F.col("t") / F.lit(total)).alias("p"))

    def figures(low: float, high: float):
        step = (high - low) / POINTS
        grid = F.explode(F.sequence(F.lit(0), F.lit(POINTS))).alias("k")
        a = F.lit(low) + F.col("k") * F.lit(step)
        rows = (live.select("p", grid).withColumn("a", a).groupBy("k", "a")
                .agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"), F.max("p").alias("top"), F.min("p").alias("low"),
                     F.count("*").alias("n")))
        entropy = F.log("z") - F.col("a") * F.col("s") / F.col("z")
        repeats = (F.pow(F.col("top") / F.col("low"), 1 - F.col("a")) if budget is None
                   else F.lit(budget / total) * F.pow("low", F.col("a") - 1) / F.col("z"))
        return rows.agg(F.max(F.when(entropy >= entropy_share * F.log("n"), F.col("k"))).alias("even"),
                        F.min(F.when(repeats <= max_repeats, F.col("k"))).alias("few")).first(), step

    low, high = 0.0, 1.0
    for _ in range(PASSES):  # the last point that is even enough
        found, step = figures(low, high)
        if found.even is None or found.even == POINTS:
            low = low if found.even is None else high
            break
        low, high = low + found.even * step, low + (found.even + 1) * step
    even = low
    low, high = 0.0, 1.0
    for _ in range(PASSES):  # the first point that repeats little enough
        found, step = figures(low, high)
        if found.few is None or found.few == 0:
            high = low if found.few == 0 else high
            break
        low, high = low + (found.few - 1) * step, low + found.few * step
    return round(max(even, high), 6)


def budgets(blocks: DataFrame, entropy_share: float, max_repeats: float, budget: int | None) -> DataFrame:
    """mix_source, t (tokens there), weight, quota (tokens to take)."""
    sources = stage(blocks.groupBy("mix_source").agg(F.sum("t").alias("t")))
    head = sources.agg(F.sum("t").alias("t"), F.max("t").alias("top")).first()
    if not head.t:
        return sources.select("mix_source", "t", F.lit(0.0).alias("weight"), F.col("t").alias("quota"))
    a = exponent(sources, head.t, entropy_share, max_repeats, budget)
    part = F.pow(F.col("t") / F.lit(head.t), F.lit(a))
    z = sources.where("t > 0").agg(F.sum(part)).first()[0]
    weight = F.when(F.col("t") > 0, part / F.lit(z)).otherwise(0.0)
    quota = (F.floor(F.col("t") * F.pow(F.col("t") / F.lit(head.top), F.lit(a - 1))) if budget is None
             else F.floor(weight * F.lit(budget))).cast("long")
    return sources.select("mix_source", "t", weight.alias("weight"), F.when(F.col("t") > 0, quota).otherwise(0).cast("long").alias("quota"))


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None) -> DataFrame:
    """``docs``, each row as often as the mixture takes it, with n_tokens, epoch, start_tokens (tokens of its source before it) and slot."""
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    keyed = _keyed(docs, names)
    blocks = stage(keyed.groupBy("mix_source", "mix_block").agg(F.sum("n_tokens").alias("t")))
    quotas = stage(budgets(blocks, entropy_share, max_repeats, budget_tokens)).select("mix_source", F.col("t").alias("of"), "quota")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("of") > 0, F.floor(F.col("quota") / F.col("of"))).otherwise(0))).alias("epoch")
    turn = F.md5(F.concat_ws(":", "mix_source", "mix_block", F.col("epoch").cast("string")).cast("binary"))
    ahead = Window.partitionBy("mix_source", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    plan = (blocks.join(quotas, "mix_source").select("*", epochs).withColumn("turn", turn)
            .withColumn("before", F.col("epoch") * F.col("of") + F.coalesce(F.sum("t").over(ahead), F.lit(0)))
            .where("before < quota OR (of = 0 AND epoch = 0) OR (t = 0 AND before <= quota AND epoch * of < quota)")
            .select("mix_source", "mix_block", "epoch", "before", "quota"))
    inner = (Window.partitionBy("mix_source", "mix_block", "epoch").orderBy("order", "mix_row")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.join(plan, ["mix_source", "mix_block"])
              .withColumn("order", F.md5(F.concat_ws(":", "mix_row", F.col("epoch").cast("string")).cast("binary")))
              .withColumn("start_tokens", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
              .where("start_tokens + n_tokens <= quota"))
    slot = F.when(F.col("quota") > 0, F.col("start_tokens") / F.col("quota")).otherwise(0.0)
    return placed.withColumn("slot", slot).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], *RESULTS)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", *RESULTS)


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    coalesce('s' || source, 'n') AS k, md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS r FROM documents),
b AS (SELECT k, r[1:{BLOCK_DIGITS}] AS b, sum(n_tokens)::BIGINT AS t FROM d GROUP BY ALL),
s AS (SELECT k, sum(t)::BIGINT AS t, sum(t) / sum(sum(t)) OVER () AS p, max(sum(t)) OVER () AS top FROM b GROUP BY k),
l AS (SELECT list(p::DOUBLE) AS ps FROM s WHERE t > 0),
e(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN h >= {ENTROPY_SHARE} * ln(len(ps)) THEN m ELSE lo END, CASE WHEN h >= {ENTROPY_SHARE} * ln(len(ps)) THEN hi ELSE m END
  FROM (SELECT i, lo, hi, m, ps, ln(list_sum(list_transform(ps, lambda x: pow(x, m))))
          - m * list_sum(list_transform(ps, lambda x: pow(x, m) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, m))) AS h
        FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN 1.0 ELSE (lo + hi) / 2 END AS m, ps FROM e, l) WHERE i < 45)),
g AS (SELECT round(greatest((SELECT arg_max(lo, i) FROM e), 0, coalesce((SELECT 1 - ln({MAX_REPEATS}) / nullif(ln(list_max(ps) / list_min(ps)), 0) FROM l), 0)), 6) AS a),
q AS (SELECT k, t, CASE WHEN t > 0 THEN floor(t * pow(t / top, (SELECT a FROM g) - 1))::BIGINT ELSE 0 END AS quota FROM s),
x AS (SELECT b.k, b.b, b.t, q.t AS of, quota, unnest(range(0, CASE WHEN q.t > 0 THEN quota // q.t ELSE 0 END + 1)) AS epoch FROM b JOIN q USING (k)),
y AS (SELECT *, epoch * of + coalesce(sum(t) OVER (PARTITION BY k, epoch ORDER BY md5(k || ':' || b || ':' || epoch)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
z AS (SELECT d.*, epoch, quota, before + coalesce(sum(n_tokens) OVER (PARTITION BY d.k, y.b, epoch ORDER BY md5(r || ':' || epoch), r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_tokens
      FROM d JOIN y ON y.k = d.k AND y.b = d.r[1:{BLOCK_DIGITS}]
      WHERE before < quota OR (of = 0 AND epoch = 0) OR (t = 0 AND before <= quota AND epoch * of < quota))
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, start_tokens::BIGINT AS start_tokens,
  CASE WHEN quota > 0 THEN start_tokens::DOUBLE / quota::DOUBLE ELSE 0.0 END AS slot FROM z WHERE start_tokens + n_tokens <= quota
"""
