"""Quality rules as a short-circuit cascade.

Each rule is a measure of one text and a verdict on it. On a sample every rule is timed and its rejections counted; rules then run
in the order of rejection per cost, and a text that one rule rejects is not shown to the later ones. The order changes cost only:
a text is kept when every rule accepts it, so the result does not depend on the sample. The expensive measure (repeated word
windows) is only taken where the cheaper rules leave a text alive, unless the caller asks for all measures.

The sample is the ``SAMPLE_ROWS`` distinct texts with the smallest hashes (bounded; it fixes the order and nothing else).

Words are ``[^\\x20\\x09-\\x0D]+``. Null or empty text: no words, all counts 0, rejected by ``few_words``. Null ids, repeated rows and
other columns: every row is judged by itself and kept as it is. Ties in the order go by rule name. Empty table: empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of, batches_of_bytes, documents, lean, sample_texts

SAMPLE_ROWS = 400
#: Bytes of text whose words are alive at a time.
TEXT_BYTES = 1 << 18
WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """One text; measures are taken on demand and once."""

    __slots__ = ("text", "_words", "_taken")

    def __init__(self, text: str | None):
        self.text, self._words, self._taken = text or "", None, {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.text.encode("utf-8", "surrogatepass").split()
        return self._words

    def __getitem__(self, measure: str) -> int:
        if measure not in self._taken:
            self._taken[measure] = TAKE[measure](self)
        return self._taken[measure]


def _word_chars(t: Text) -> int:
    return len(t.text) - sum(map(t.text.count, " \t\n\v\f\r"))


def _dup_lines(t: Text) -> int:
    lines = [line for line in t.text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def repeat_words(words: list) -> int:
    """Words inside windows of eight words that occur twice or more: ranks of 1, 2, 4 and 8 words, each exact from two of the last."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ranks = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pairs = ranks[:len(ranks) - width] * np.int64(len(words) + 1) + ranks[width:]
        ordered = np.sort(pairs)
        if not (ordered[1:] == ordered[:-1]).any():
            return 0
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


TAKE: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": lambda t: repeat_words(t.words),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The two base rules, then the cascade's own. The latter are lenient: only texts that are clearly no prose fail.
BASE = (
    Rule("few_words", lambda t: t["n_words"] < 20),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t["n_symbols"] > 3 * t["n_words"]),
    Rule("word_length", lambda t: not 2 * t["n_words"] <= t["word_chars"] <= 25 * t["n_words"]),
    Rule("repeated_lines", lambda t: 2 * t["n_dup_lines"] > t["text_lines"]),
)
TAKE["text_lines"] = lambda t: sum(1 for line in t.text.split("\n") if line.strip(" \t\v\f\r"))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def rank(self) -> tuple:
        return (-(self.rejected + 0.5) / max(self.seconds, 1e-9), self.rule.name)


def estimate(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """Cost and rejections of each rule alone on the sample, best rejection per cost first."""
    out = []
    for rule in rules:
        begun = time.perf_counter()
        rejected = sum(rule.rejects(Text(t)) for t in texts)
        out.append(Estimate(rule, time.perf_counter() - begun, rejected))
    return sorted(out, key=lambda e: e.rank)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[Rule]:
    if len(rules) < 2:
        return list(rules)
    rows = sample_texts(docs, text, SAMPLE_ROWS)
    names = [r.name for r in rules]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 128):
            found = sorted(estimate(batch.column(0).to_pylist(), rules), key=lambda e: names.index(e.rule.name))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([e.seconds for e in found]), pa.array([e.rejected for e in found])],
                                             names=["rule", "seconds", "rejected"])

    sums = (rows.mapInArrow(lean(judged), "rule string, seconds double, rejected long").groupBy("rule")
            .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect())  # one row per rule
    if not sums:
        return list(rules)
    by = {r.name: r for r in rules}
    return [e.rule for e in sorted((Estimate(by[r.rule], r.seconds, r.rejected) for r in sums), key=lambda e: e.rank)]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``docs`` with ``base_failed`` and ``kept``; ``measures`` are added as columns, taken for every row."""
    order = plan(docs, rules, text)
    rest = [r for r in order if r not in BASE]
    new = [*measures, "base_failed", "kept"]
    kept = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, text, TEXT_BYTES):
            texts = [Text(t) for t in batch.column(text).to_pylist()]
            taken = [[t[m] for t in texts] for m in measures]
            if measures:
                failed = [any(r.rejects(t) for r in BASE if r in order) for t in texts]
                ok = [not f and not any(r.rejects(t) for r in rest) for t, f in zip(texts, failed, strict=True)]
            else:  # base_failed is only known as far as the cascade went
                stopped = [next((r for r in order if r.rejects(t)), None) for t in texts]
                failed, ok = [None if s is not None and s not in BASE else s is not None for s in stopped], [s is None for s in stopped]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in taken), pa.array(failed, pa.bool_()),
                                              pa.array(ok, pa.bool_())], names=[*batch.schema.names, *new])

    schema = kept
    for m in measures:
        schema = schema.withColumn(m, F.lit(None).cast("long"))
    return kept.mapInArrow(lean(run), schema.withColumns({"base_failed": F.lit(None).cast("boolean"), "kept": F.lit(None).cast("boolean")}).schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return cascade(documents(spark, sf_dir).select("doc_id", "text"), measures=MEASURES).select("doc_id", *MEASURES, "base_failed", "kept")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS lines FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > 3 * n_words AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND NOT 2 * n_dup_lines > lines AS kept
FROM b
"""
