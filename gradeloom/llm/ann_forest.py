"""Nearest neighbours by a hash-prefix forest.

The rows are dealt by hash to shards of about ``SHARD_ROWS``; each shard holds a forest: per tree, every row's hash string (``BITS`` bits: on
which side of a random direction's cut the vector lies) in one sorted array. A prefix of a query's string is a range of that array.
A search descends in all trees to the longest prefixes, then ascends in all trees together, one bit at a time, and at the last level
tree by tree, until enough rows of the shard are in reach; those are measured exactly on the original vectors. Cuts are quantiles of
the shard's projections, so trees are balanced wherever the vectors lie.

Queries go to the shards in blocks of ``QUERY_BLOCK`` (a broadcast of bounded size); each shard answers with its ``k`` nearest, and these
are merged by query. The index is a written table; every row is in it.

``share`` is the part of a shard that must be in reach: vectors without structure (random directions in 64 dimensions) have their
neighbours almost everywhere, so a recall of 0.9 there needs about half of the rows. ``FEWEST`` rows are always in reach, so small
tables are searched whole. Measured recall is in the README.

Vectors that are null, empty, zero or hold null or non-finite components, and null vec_ids, take no part. Repeated rows count once; different
vectors under one vec_id are different rows, all of them excluded for a query of that id. Vectors meet only those of equal length. Ties
go to the smaller vec_id. Extra columns are not looked at. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, stage

TREES, BITS = 16, 24
SHARD_ROWS, QUERY_BLOCK, FEWEST, SHARE = 4096, 4096, 1024, 0.65
SEED = 20240917

_INDEX = pa.schema([("n", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("cuts", pa.binary()),
                    ("keys", pa.binary()), ("order", pa.binary())])
_INDEX_DDL = "n long, dim int, ids binary, vectors binary, cuts binary, keys binary, order binary"
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(table: DataFrame) -> DataFrame:
    """Distinct vec_id and embedding (as doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return (table.where(F.col("vec_id").isNotNull() & F.coalesce(~bad & some, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).distinct())


def directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions (trees, bits, dim) and the quantile at which each cuts; the same for every shard."""
    r = np.random.default_rng([SEED, dim])
    return r.standard_normal((TREES, BITS, dim)), r.uniform(0.35, 0.65, (TREES, BITS))


def strings(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hash strings (trees, rows) as integers, first bit highest."""
    planes, _ = directions(vectors.shape[1])
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.stack([((vectors @ planes[t].T > cuts[t]).astype(np.uint64) * weights).sum(1, dtype=np.uint64) for t in range(TREES)])


def build(group: pa.Table) -> pa.Table:
    """The forests of one shard, one per vector length."""
    by: dict[int, list[tuple[int, list]]] = {}
    for i, v in zip(group.column("vec_id").to_pylist(), group.column("embedding").to_pylist(), strict=True):
        by.setdefault(len(v), []).append((i, v))
    out = []
    for dim, rows in by.items():
        rows.sort()
        ids, vectors = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64)
        planes, shares = directions(dim)
        cuts = np.stack([[np.quantile(p, q) for p, q in zip(planes[t] @ vectors.T, shares[t], strict=True)] for t in range(TREES)])
        keys = strings(vectors, cuts)
        order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        out.append({"n": len(ids), "dim": dim, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "cuts": cuts.tobytes(),
                    "keys": np.take_along_axis(keys, order, 1).tobytes(), "order": order.tobytes()})
    return pa.Table.from_pylist(out, schema=_INDEX)


def index(table: DataFrame) -> DataFrame:
    """The written index of all usable rows."""
    rows = stage(usable(table))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)))
    return stage(placed.groupBy("shard").applyInArrow(build, _INDEX_DDL))


class Shard:
    def __init__(self, row: dict):
        self.n, dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(self.n, dim)
        self.cuts = np.frombuffer(row["cuts"], np.float64).reshape(TREES, BITS)
        self.keys = np.frombuffer(row["keys"], np.uint64).reshape(TREES, self.n)
        self.order = np.frombuffer(row["order"], np.int32).reshape(TREES, self.n)

    def reach(self, queries: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """For each query, the rows in reach: descend to the longest common prefixes, ascend together until enough."""
        wanted = min(self.n, max(FEWEST, int(np.ceil(share * self.n))))
        asked = strings(queries, self.cuts)
        low, high = (np.zeros((BITS + 1, TREES, len(queries)), np.int64) for _ in range(2))
        for level in range(BITS + 1):
            rest = np.uint64(BITS - level)
            head = asked >> rest
            for t in range(TREES):
                low[level, t] = np.searchsorted(self.keys[t], head[t] << rest)
                high[level, t] = np.searchsorted(self.keys[t], (head[t] + np.uint64(1)) << rest)
        # the deepest level whose ranges could hold enough together; above it the union is counted
        sums = (high - low).sum(1)
        for q in range(len(queries)):
            level = int(np.flatnonzero(sums[:, q] >= wanted)[-1])
            inside = np.zeros(self.n, bool)
            if level < BITS:
                for t in range(TREES):
                    inside[self.order[t, low[level + 1, t, q]:high[level + 1, t, q]]] = True
            while True:
                for t in range(TREES):
                    inside[self.order[t, low[level, t, q]:high[level, t, q]]] = True
                    if np.count_nonzero(inside) >= wanted:
                        break
                else:
                    level -= 1
                    continue
                break
            yield np.flatnonzero(inside)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, rows in enumerate(self.reach(queries, share)):
            rows = rows[self.ids[rows] != query_ids[q]]
            if len(rows):
                d = np.sqrt(((self.vectors[rows] - queries[q]) ** 2).sum(1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    rows, d = rows[near], d[near]
                by = np.lexsort((self.ids[rows], d))[:k]
                yield q, self.ids[rows][by], d[by]


def search(table: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row (vec_id, embedding), nearest first."""
    spark = table.sparkSession
    forest = index(table)
    asked = stage(usable(queries))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):  # a block of bounded size at a time
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).collect()
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.vec_id, r.embedding)):
            by.setdefault(len(r.embedding), []).append(r)
        block = spark.sparkContext.broadcast({dim: (np.array([r.vec_id for r in rs], np.int64), np.array([r.embedding for r in rs], np.float64))
                                              for dim, rs in by.items()})

        def run(batches: Iterator[pa.RecordBatch], b=b, block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    ids, vectors = block.value.get(row["dim"], (np.zeros(0, np.int64), None))
                    if not len(ids):
                        continue
                    got = list(Shard(row).nearest(ids, vectors, k, share))
                    sizes = [len(i) for _, i, _ in got]
                    q = np.repeat([q for q, _, _ in got], sizes).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((row["dim"] << 40) + q * blocks + b), pa.array(ids[q]), pa.array(np.concatenate([x for _, x, _ in got] or [ids[:0]])),
                                                      pa.array(np.concatenate([d for _, _, d in got] or [np.zeros(0)]))], schema=_FOUND)

        parts.append(stage(forest.mapInArrow(run, "query long, query_id long, vec_id long, score double")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    turn = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann_forest(spark, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(table, table.where("vec_id % 100 = 0"))
