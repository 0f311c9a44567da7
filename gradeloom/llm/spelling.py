"""Spelling variants: each word's near words (one edit apart) and its prevailing form, by an index of variable-length grams.

* Dictionary: grams of ``QMIN`` to ``QMAX`` code points, pruned by frequency: a gram is lengthened only where it occurs more than a cut
  times in the words, the cut being the number of gram positions over ``DICTIONARY``. So at most ``DICTIONARY`` grams of a length
  are over the cut (a bound whatever the input), and only these are known by name to the tasks.
* Decomposition: at every place the shortest gram that is not over the cut (or is ``QMAX`` long, or meets the end); grams inside an
  earlier one are left out.
* Affected grams: one edit touches the grams that read its place, and those left of which it may make a longer gram that swallows
  them. The most that any one place touches is the word's own bound ``b``; of ``m`` grams at least ``m - b`` come back in a near word, at the
  same distance from the start (edit behind them) or from the end (edit before them).
* List merging: two words that share ``m - b`` grams share one of their ``b + 1`` rarest, whichever word's bound is taken, so the
  lists of these alone are merged: an equi-join on gram, place and length. Words whose bound leaves nothing (short, all of it in long grams)
  also enter an index of plain trigrams, where a word of seven code points keeps two.
* Verification: a parity signature (one edit flips two bits at most), then the edit distance itself.

Words: maximal runs of letters, see ``word_counts``. Null text: no words. A null doc_id counts as an empty id. Repeated rows count again.
Ties between forms: the smallest in code-point order. Extra columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of, documents, stage

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, SLIP, PREVAILS = 7, 2, 31, 10
QMIN, QMAX, BASE = 2, 5, 3
#: At most so many grams of a length are over the cut; a fixed size of what the tasks know by name.
DICTIONARY = 1 << 16
#: Grams a task counts before it hands them on; a matter of speed and memory only.
COUNTED = 400_000

GRAMS = "array<struct<gram:string,at:int>>"


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_LENGTH) -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters with at least ``least`` code points, after the slip of one letter in a 31st of them."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    slipped = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.expr("substr(run, cast(h % length(run) as int) + 2)"))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, n for all grams of ``QMIN`` to ``QMAX`` code points at all places of ``word``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in range(QMIN, QMAX + 1):
                    seen.update([word[i:i + q] for i in range(len(word) - q + 1)])
                if len(seen) > COUNTED:
                    yield flush(seen)
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])
        seen.clear()
        return out

    return words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Dictionary:
    """Grams over the cut, and how words fall into grams."""

    def __init__(self, over: dict[str, int]):
        self.over = over
        #: endings of lengthened grams: what may stand between an edit and the last character of a new gram
        self.endings = {g[i:] for g in over for i in range(len(g) + 1)}

    def grams(self, word: str) -> list[tuple[int, int, bool]]:
        """(begin, end, ended by the end of the word) of the word's grams, none inside an earlier one."""
        out, reach, size, over = [], 0, len(word), self.over
        for begin in range(size - QMIN + 1):
            end, last = begin + QMIN, begin + QMAX
            while end < last and end < size and word[begin:end] in over:
                end += 1
            if end > reach:
                out.append((begin, end, end == size and end < last and word[begin:end] in over))
                reach = end
        return out

    def bound(self, word: str, grams: list[tuple[int, int, bool]]) -> int:
        """The most grams that one edit can touch."""
        change, size = [0] * (len(word) + 2), len(word)
        for begin, end, open_end in grams:
            low = begin
            while low > 0 and end - low < QMAX and word[low:end - 1] in self.endings:
                low -= 1  # an edit at low may begin or lengthen a gram that reaches this one's end
            change[low] += 1
            change[size + 1 if open_end else end] -= 1
        most = now = 0
        for step in change:
            now += step
            most = max(most, now)
        return most

    def keys(self, word: str) -> tuple[list[tuple[str, int]], bool]:
        """The rarest grams of a word, as many as its bound and one, and whether these are enough to meet every near word."""
        grams = self.grams(word)
        bound = self.bound(word, grams)
        rare = sorted((self.over.get(word[b:e], 0), word[b:e], b) for b, e, _ in grams)
        return [(g, b) for _, g, b in rare[:bound + 1]], bound < len(grams)

    def base_keys(self, word: str) -> list[tuple[str, int]]:
        """The rarest plain grams of ``BASE`` code points, one more than an edit can touch."""
        rare = sorted((self.over.get(word[b:b + BASE], 0), word[b:b + BASE], b) for b in range(len(word) - BASE + 1))
        return [(g, b) for _, g, b in rare[:BASE + 1]]


def _signature(word: str) -> int:
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) * 11 & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def decomposed(words: DataFrame) -> DataFrame:
    """word, n, size, sig, rare (gram, at), base (gram, at; empty unless needed) of every row of ``words`` (word, n)."""
    counts = stage(gram_counts(words))
    positions = counts.agg(F.sum(F.when(F.length("gram") == QMIN, F.col("n")))).first()[0] or 0
    cut = positions // DICTIONARY + 1
    over = {r.gram: r.n for r in counts.where(F.col("n") > cut).collect()}  # at most DICTIONARY of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary(over)
        for batch in batches_of(batches, 4096):
            texts = batch.column("word").to_pylist()
            rare, base = [], []
            for word in texts:
                keys, enough = dictionary.keys(word)
                rare.append(keys)
                base.append([] if enough else dictionary.base_keys(word))
            kind = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))
            lists = [pa.array([[{"gram": g, "at": a} for g, a in k] for k in side], kind) for side in (rare, base)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in texts], pa.int32()),
                                              pa.array([_signature(w) for w in texts], pa.int64()), *lists],
                                             names=["word", "n", "size", "sig", "rare", "base"])

    return words.select("word", "n").mapInArrow(run, f"word string, n long, size int, sig long, rare {GRAMS}, base {GRAMS}")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two words of ``words`` (word, n; words distinct) that are one edit apart, in both orders."""
    grams = stage(decomposed(words))
    each = grams.select("word", "n", "sig", "size", F.explode(F.concat(
        F.transform("rare", lambda g: F.struct(F.lit("v").alias("index"), g.gram.alias("gram"), g.at.alias("at"))),
        F.transform("base", lambda g: F.struct(F.lit("b").alias("index"), g.gram.alias("gram"), g.at.alias("at"))))).alias("g"))
    behind = F.col("size") - F.col("g.at") - F.length("g.gram")

    def way(kind: int, at, shorter, role: int):
        return F.struct(F.xxhash64("g.index", "g.gram", at, shorter, F.lit(kind)).alias("key"), F.lit(role).alias("role"))

    # Ways of meeting: equal lengths (role 0), or the shorter (1) and the longer (2) word, the edit being behind or before the gram.
    ways = [way(0, F.col("g.at"), F.col("size"), 0)]
    for shorter, role in ((F.col("size"), 1), (F.col("size") - 1, 2)):
        ways += [way(1, F.col("g.at"), shorter, role), way(2, behind, shorter, role)]
    keyed = each.select("word", "n", "sig", F.explode(F.array(*ways)).alias("w")).select("w.key", "w.role", "word", "n", "sig")
    # both sides are one shuffle; a condition on one role alone would be pushed below it and part them
    met = keyed.alias("a").join(keyed.alias("b"), F.expr("a.key = b.key")).where(
        "a.role * 3 + b.role IN (0, 5) AND (a.role = 1 OR a.word < b.word) AND bit_count(a.sig ^ b.sig) <= 2 AND levenshtein(a.word, b.word, 1) = 1")
    both = met.select(F.explode(F.array(
        F.struct(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")),
        F.struct(F.col("b.word").alias("word"), F.col("b.n").alias("n"), F.col("a.word").alias("near"), F.col("a.n").alias("near_n")))).alias("p"))
    return both.select("p.*").repartition("word").distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of ``words`` (word, n; words distinct), see ``op11_spelling``."""
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    fits = -F.col("best.n") >= PREVAILS * F.col("n")
    rows = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"),
                               F.when(fits, -F.col("best.n")).alias("form_n")))
    most = rows.agg(F.max("n")).first()[0] or 1
    # every step to a form multiplies the count by ten, so chains are short; every round doubles the way
    steps = int(math.log10(most)) + 1
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        roots = stage(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    words = stage(word_counts(documents(spark, sf_dir)).where(F.col("n") >= LEAST_COUNT))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 byte by byte (letters up to U+00FF are one or two bytes); near words meet in what one deletion leaves.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS round, range AS c FROM range(256)
  UNION ALL SELECT i, round + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE round < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE round = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (
  SELECT id, run, times, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)),
    lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
  SELECT word, n, length(word) AS size, spot, left(word, spot - 1) || substr(word, spot + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rank, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.rank = 1),
walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) w USING (word)
"""
