"""Ranked lexical search: MaxScore over document shards, with bounds tightened by term-pair intersection lists.

* Index: one pass over the texts; every task closes a shard after ``SHARD_TOKENS`` terms: sorted postings (document, frequency) per
  term, document lengths, document frequencies. All terms and all documents are indexed; texts are not shuffled.
* Weights: N, L and the document frequencies of the queries' terms are sums over shards.
* Pair lists: for terms that stand next to each other in the order of weight within an item (the frequent ones meet most), a shard
  intersects the postings once for all items and stores the documents with both impacts; their joint maximum is at most, and
  mostly less than, the sum of both maxima.
* Search in a shard: terms in ascending order of weight; the bound of the first j terms is the least over all ways to split them into
  single terms (own maximum) and stored pairs (joint maximum). While that bound is under the score of the k-th best so far, documents
  with none but these terms cannot enter and are never scored; the rest is filled in for the documents whose score plus the bound still
  reaches it. Thresholds start from the k-th best of any single list or pair list and, within a task, carry over from shard to shard.
* The shards' best ``k`` are ranked once more; a task hands on at most ``k`` rows per item and shard.

Scores are 64-bit integers, see ``op13_pair_maxscore``. Items are dealt in blocks of about ``BLOCK_TERMS`` terms; every block meets every
shard by an equi-join on the block number, which is broadcast while there are at most ``BROADCAST_BLOCKS`` blocks and shuffled beyond.

Null or empty text: no terms, never found, asks nothing. Null doc_id: last among equal scores. Repeated rows are documents of their own; rows of
one id and other texts are items of their own, equal rows one item. Extra columns are not read. Empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of_bytes, documents, lean, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Terms of a shard, and of a block of items; a matter of memory and speed only.
SHARD_TOKENS, BLOCK_TERMS, BROADCAST_BLOCKS = 1 << 20, 1 << 16, 8
#: Bytes of texts that are cut at a time, and what the operator's workers hold is named by.
TEXT_BYTES, OWNER = 1 << 20, "op13"
#: Query terms up to which the document-frequency join broadcasts them.
BROADCAST_TERMS = 200_000
NO_DOC = np.iinfo(np.int64).max

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms (A-Z lower-cased, all of a character above ASCII), blanks for the rest.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

SHARD = pa.schema([("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
SHARD_SQL = "terms array<binary>, dfs array<int>, docs array<int>, tfs array<int>, doc_ids array<bigint>, sizes array<int>"


class Shard:
    """Postings of the documents met so far."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else ()
        if words:
            number = self.number
            self.terms.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            self.doc_ids.append(doc_id)
            self.sizes.append(len(words))
            self.tokens += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.tokens:
            return
        width = len(self.sizes)
        owner = np.repeat(np.arange(width, dtype=np.int64), self.sizes)
        keys, tfs = np.unique(np.concatenate(self.terms).astype(np.int64) * width + owner, return_counts=True)
        dfs = np.bincount(keys // width, minlength=len(self.number))
        columns = [list(self.number), dfs, keys % width, tfs, self.doc_ids, self.sizes]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, SHARD, strict=True)], schema=SHARD)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of ``docs``: terms with document frequencies, postings in the order of the terms, ids and sizes of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches_of_bytes(batches, "text", TEXT_BYTES):
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(number, words.as_py())
                if shard.tokens >= SHARD_TOKENS:
                    yield from shard.rows()
                    shard = Shard()
        yield from shard.rows()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).alias("text")).mapInArrow(lean(run, OWNER), SHARD_SQL)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """key, item_id, term, c: how often each term stands in an item."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(item_id).cast("string"), F.lit("-")), text)).alias("key")
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(key, F.col(item_id).cast("long").alias("item_id"), found.alias("terms")).distinct()
    return rows.select("key", "item_id", F.explode("terms").alias("term")).groupBy("key", "item_id", "term").agg(F.count("*").alias("c"))


def weights(shards: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, w) for the terms of the queries that some document holds, N and L."""
    total = shards.agg(F.sum(F.size("sizes")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n, size = total.n or 0, total.l or 0
    asked = stage(terms.select(F.col("term").cast("binary").alias("term")).distinct())
    side = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    held = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = held.join(side, "term").groupBy("term").agg(F.sum("df").alias("df"))
    return df.select("term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")), n, size


class Lists:
    """Impacts of one shard: per term, and per pair of terms where both stand in a document."""

    def __init__(self, shard: dict, asked: pa.Array, n: int, size: int):
        at = pc.index_in(asked, value_set=shard["terms"])  # only the asked terms become Python objects
        self.number = {t: i for t, i in zip(asked.to_pylist(), at.to_pylist(), strict=True) if i is not None}
        self.ends = np.concatenate([[0], np.cumsum(shard["dfs"], dtype=np.int64)])
        self.docs, self.tfs, self.doc_ids = shard["docs"], shard["tfs"], shard["doc_ids"]
        self.rough = 12 * (75 + 25 * shard["sizes"].astype(np.int64) * n // size)
        self.terms: dict[bytes, tuple | None] = {}
        self.pairs: dict[tuple, tuple | None] = {}

    def term(self, term: bytes, w: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents and impacts of a term."""
        if term not in self.terms:
            i = self.number.get(term)
            if i is None:
                self.terms[term] = None
            else:
                part = slice(self.ends[i], self.ends[i + 1])
                docs, tf = self.docs[part], self.tfs[part].astype(np.int64)
                self.terms[term] = docs, w * (1_000_000_000 * tf // (1000 * tf + self.rough[docs]))
        return self.terms[term]

    def pair(self, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Impacts of both terms in the documents that hold both; their lists are in reach already."""
        if (a, b) not in self.pairs:
            (docs, left), (others, right) = self.terms[a], self.terms[b]
            at = np.searchsorted(docs, others)
            at[at == len(docs)] = 0
            both = docs[at] == others
            self.pairs[a, b] = (left[at[both]], right[both])
        return self.pairs[a, b]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def prefix_bounds(tops: list[int], joint: list[int | None]) -> list[int]:
    """Bounds of the first 0, 1, ... terms; ``joint[i]`` is the stored joint maximum of terms i - 1 and i, if any."""
    bounds = [0]
    for i, top in enumerate(tops):
        bound = bounds[i] + top
        if i and joint[i] is not None:
            bound = min(bound, bounds[i - 1] + max(joint[i], tops[i - 1], top))
        bounds.append(bound)
    return bounds


def search(lists: Lists, terms: list[tuple[bytes, int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) and scores of the best ``k`` for an item (term, w, c in ascending order of w) that reach ``floor``."""
    held = [(t, c, got) for t, w, c in terms if (got := lists.term(t, w)) is not None]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    impacts = [(docs, c * own) for _, c, (docs, own) in held]
    tops = [int(own.max()) for _, own in impacts]
    least, joint = max(floor, 1), [None]
    for i in range(1, len(held)):
        left, right = lists.pair(held[i - 1][0], held[i][0])
        both = held[i - 1][1] * left + held[i][1] * right
        joint.append(int(both.max()) if len(both) else 0)
        least = max(least, kth(both, k))
    least = max(least, *(kth(own, k) for _, own in impacts))
    bounds = prefix_bounds(tops, joint)
    first = next((j for j in range(len(held), 0, -1) if bounds[j] < least), 0)  # terms before it find no document of their own
    if first == len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores = np.zeros(len(lists.doc_ids), np.int64)
    for docs, own in impacts[first:]:
        scores[docs] += own
    found = np.flatnonzero(scores)
    for j in range(first, -1, -1):
        part = scores[found]
        least = max(least, kth(part, k))
        found = found[part + bounds[j] >= least]
        if j:
            docs, own = impacts[j - 1]
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            hit = docs[at] == found
            scores[found[hit]] += own[at[hit]]
    order = np.lexsort((lists.doc_ids[found], -scores[found]))[:k]
    return found[order], scores[found[order]]


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, key, rank, doc_id, score: the best ``k`` documents of every item (item_id, text); key tells items of one id apart."""
    shards = stage(index(docs), rows_per_file=1)  # a reader holds all rows of a file at once
    asked = stage(item_terms(items))
    weight, n, size = weights(shards, asked)
    weighted = asked.withColumn("term", F.col("term").cast("binary")).join(weight, "term")
    blocks = asked.count() // BLOCK_TERMS + 1
    per_item = weighted.groupBy("key", "item_id").agg(F.sort_array(F.collect_list(F.struct("w", "term", "c"))).alias("terms"))
    dealt = (per_item.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
             .agg(F.collect_list(F.struct("key", "item_id", "terms")).alias("items")))
    dealt = stage(dealt)
    every = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.join(F.broadcast(dealt) if blocks <= BROADCAST_BLOCKS else dealt, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        queries: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].values for c in SHARD.names}
                shard = {c: v if c == "terms" else v.fill_null(NO_DOC if c == "doc_ids" else 0).to_numpy() for c, v in shard.items()}
                block = batch.column("block")[i].as_py()
                if block not in queries:
                    queries = {block: batch.column("items")[i].as_py()}  # one block at a time stays parsed
                    asked = pa.array(list({t["term"]: None for item in queries[block] for t in item["terms"]}), pa.binary())
                lists = Lists(shard, asked, n, size)
                out: list[tuple] = []
                for item in queries[block]:
                    seen = best.get(item["key"], np.zeros(0, np.int64))
                    terms = [(t["term"], t["w"], t["c"]) for t in item["terms"]]
                    found, scores = search(lists, terms, k, kth(seen, k))
                    best[item["key"]] = -np.sort(-np.concatenate([seen, scores]))[:k]
                    out += [(item["key"], item["item_id"], None if d == NO_DOC else d, s)
                            for d, s in zip(lists.doc_ids[found].tolist(), scores.tolist(), strict=True)]
                names = ["key", "item_id", "doc_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string() if c == 0 else pa.int64()) for c in range(4)], names=names)

    hits = met.mapInArrow(lean(run, OWNER), "key string, item_id long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "key", "rank", "doc_id", "score")


def op13_pair_maxscore(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (
  SELECT a.item_id, p.doc_id,
    CAST(sum(a.c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // l))))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN postings p USING (term) JOIN sizes s ON s.doc_id = p.doc_id, totals
  GROUP BY a.item_id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
