"""Personal data by patterns and by a semi-Markov conditional random field.

Patterns give the base spans (e-mail, IP, card, phone), each kind leftmost without overlaps. The field scores whole segments of up
to ``MAX_TOKENS`` tokens: checksum, digit count, separators, dotted parts and neighbours of the segment as a unit, and bounded-entity
dynamic programming chooses borders and kinds together. Its segments that overlap no base span are added; base spans always stay.

A segment needs a digit or an at sign in every blank-separated word, so words without one are outside by construction and the
programme runs over islands of such words only; the best labelling of an island does not depend on the rest of the text.

Weights are fitted on a bounded sample: up to ``SAMPLE_DOCS`` documents that contain a digit or an at sign, those with the smallest
hashes, and of these up to ``SAMPLE_ISLANDS`` islands, ``SAME_SHAPE`` of one shape at most, labelled by the patterns. Everything else covers all rows.

Null text: as empty, no spans. Null ids, repeated rows and extra columns: kept as they are; a ``spans`` column of the input is
replaced. Empty table: empty result, weights stay zero, and a zero-weight field adds nothing. Overlaps between kinds may occur in the
base (they are separate findings), never between an added span and any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of, documents, lean, sample_texts

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 16, 80
SAMPLE_DOCS, SAMPLE_ISLANDS, SAME_SHAPE, ISLANDS_PER_DOC, ISLAND_CHARS, EPOCHS = 2000, 240, 6, 32, 300, 8

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
SPANS_DDL = "array<struct<kind: string, start: long, end: long, base: boolean>>"

# Equal to the stated patterns; possessive and anchored so that long runs of one class stay linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s|$")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            yield start, floor
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    if not _SEED.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words, one blank apart, that each contain a digit or an at sign."""
    begin = end = -1
    at = 0
    while seed := _SEED.search(text, at):
        left = seed.start()
        while left > max(at, 0) and not text[left - 1].isspace():
            left -= 1
        right = _BLANK.search(text, seed.start()).start()
        if begin >= 0 and left - end == 1:
            end = right
        else:
            if begin >= 0:
                yield begin, end
            begin, end = left, right
        at = right
    if begin >= 0:
        yield begin, end


# ---- the field ----------------------------------------------------------------------------------------------------------------

def _side(char: str) -> str:
    return "-" if not char else "s" if char.isspace() else "w" if char.isalnum() else char if char in "@+.-" else "p"


def features(text: str, start: int, end: int) -> list[str]:
    """What a segment is as a whole, and what stands beside it."""
    x = text[start:end]
    digits = "".join(c for c in x if "0" <= c <= "9")
    n = len(digits)
    size = "0" if not n else "1" if n < 4 else "4" if n < 9 else "9" if n < 13 else "13" if n < 16 else "16" if n < 20 else "20"
    seps = "".join(sorted({c for c in x if not c.isalnum()}))[:8]
    parts = x.split(".")
    quad = len(parts) == 4 and all(p.isdecimal() and len(p) < 4 for p in parts)
    whole = ("mail" if _DOMAIN.fullmatch(x.partition("@")[2]) and re.fullmatch(r"[\w.%+-]+", x.partition("@")[0])
             else "quad" if quad and all(int(p) < 256 for p in parts)
             else "luhn" if 13 <= n <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", x)
             else "dial" if 9 <= n <= 15 and not re.search(r"[^0-9 ().+-]", x) else "none")
    letters = "a" if any(c.isalpha() for c in x) else "d"
    sides = _side(text[start - 1:start] if start else "") + _side(text[end:end + 1])
    return [f"whole={whole}", f"whole={whole}|{sides}", f"whole={whole}|{letters}{x[:1] == '+'}", f"digits={size}|{letters}", f"seps={seps}",
            f"digits={size}|{seps}", f"first={x[:1] if not x[:1].isalnum() else 'w'}|{letters}", "bias"]


class Island:
    """Tokens of an island, and the segments that may be entities with their features."""

    def __init__(self, text: str, begin: int, end: int, numbered):
        self.tokens = [(begin + m.start(), begin + m.end()) for m in _TOKEN.finditer(text[begin:end])]
        self.segments: dict[int, list[tuple[int, list]]] = {}  # by last token
        n = len(self.tokens)
        for i in range(n):
            if text[self.tokens[i][0]].isspace():
                continue
            seed = False
            for j in range(i, min(n, i + MAX_TOKENS)):
                a, b = self.tokens[i][0], self.tokens[j][1]
                if b - a > MAX_CHARS:
                    break
                seed = seed or bool(_SEED.search(text, self.tokens[j][0], b))
                if seed and text[b - 1].isalnum():
                    self.segments.setdefault(j, []).append((i, numbered(features(text, a, b))))


def scores(island: Island, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Score of each kind for each segment (first token, last token)."""
    return {(i, j): weights[ids].sum(0) for j, found in island.segments.items() for i, ids in found}


def best(island: Island, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """Best labelling: (kind, first token, last token). Label 0 is outside, one token each; ``moves`` scores label pairs."""
    n, k = len(island.tokens), len(KINDS) + 1
    value = np.full((n + 1, k), -np.inf)
    value[0, 0] = 0
    back: list[list] = [[None] * k for _ in range(n + 1)]
    table = scores(island, weights)
    for j in range(n):
        reach = value[j] + moves[:, 0]
        p = int(reach.argmax())
        value[j + 1, 0], back[j + 1][0] = reach[p], (j, p)
        for i, _ in island.segments.get(j, ()):
            for y, gain in enumerate(table[i, j], 1):
                reach = value[i] + moves[:, y]
                p = int(reach.argmax())
                if reach[p] + gain > value[j + 1, y]:
                    value[j + 1, y], back[j + 1][y] = reach[p] + gain, (i, p)
    out, j, y = [], n, int(value[n].argmax())
    while j:
        i, p = back[j][y]
        if y:
            out.append((y - 1, i, j - 1))
        j, y = i, p
    return out[::-1]


def _log_sum(x: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def expectations(island: Island, weights: np.ndarray, moves: np.ndarray):
    """Forward and backward sums: the expected use of each segment and of each label pair."""
    n, k = len(island.tokens), len(KINDS) + 1
    table = scores(island, weights)
    ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    ahead[0, 0], behind[n] = 0, 0
    for j in range(n):
        ways = [[] for _ in range(k)]
        ways[0].append(_log_sum(ahead[j] + moves[:, 0]))
        for i, _ in island.segments.get(j, ()):
            for y in range(1, k):
                ways[y].append(_log_sum(ahead[i] + moves[:, y]) + table[i, j][y - 1])
        ahead[j + 1] = [_log_sum(np.array(w)) if w else -np.inf for w in ways]
    total = _log_sum(ahead[n])
    used, pairs = {}, np.zeros((k, k))
    starts: dict[int, list[int]] = {}
    for j, found in island.segments.items():
        for i, _ in found:
            starts.setdefault(i, []).append(j)
    for i in range(n - 1, -1, -1):
        out = np.full(k, -np.inf)
        for j, y, gain in [(i, 0, 0.0)] + [(j, y, table[i, j][y - 1]) for j in starts.get(i, ()) for y in range(1, k)]:
            step = moves[:, y] + gain + behind[j + 1, y]
            out = np.logaddexp(out, step)
            share = np.exp(ahead[i] + step - total)
            pairs[:, y] += share
            if y:
                used[i, j, y] = share.sum()
        behind[i] = out
    return used, pairs


def gold(island: Island, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans as labels; the first kind listed wins where they overlap."""
    first, last = {a: i for i, (a, _) in enumerate(island.tokens)}, {b: i for i, (_, b) in enumerate(island.tokens)}
    taken: list[tuple[int, int, int]] = []
    for kind, a, b in spans:
        if a in first and b in last and (i := first[a]) <= (j := last[b]) < i + MAX_TOKENS and b - a <= MAX_CHARS:
            if all(j < s or i > e for _, s, e in taken):
                taken.append((KINDS.index(kind), i, j))
    return sorted(taken, key=lambda t: t[1])


def fit(samples: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, weights by kind, and label-pair weights: conditional likelihood by AdaGrad over a fixed order."""
    numbers: dict[str, int] = {}

    def numbered(names: list[str]) -> list[int]:
        return [numbers.setdefault(f, len(numbers)) for f in names]

    data = []
    for text in samples:
        for a, b in islands(text):
            island = Island(text, a, b, numbered)
            data.append((island, gold(island, [s for s in base_spans(text) if a <= s[1] and s[2] <= b])))
    weights, moves = np.zeros((len(numbers), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    w2, m2 = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(EPOCHS):
        for island, labels in data:
            used, pairs = expectations(island, weights, moves)
            ids = {(i, j): f for j, found in island.segments.items() for i, f in found}
            step = np.zeros_like(weights)
            for (i, j, y), p in used.items():
                np.add.at(step[:, y - 1], ids[i, j], -p)
            seen, y, n = np.zeros_like(moves), 0, 0
            for kind, i, j in [*labels, (None, len(island.tokens), None)]:
                while n < i:
                    seen[y, 0] += 1
                    y, n = 0, n + 1
                if kind is not None:
                    np.add.at(step[:, kind], ids[i, j], 1.0)
                    seen[y, kind + 1] += 1
                    y, n = kind + 1, j + 1
            step -= 1e-4 * weights
            w2 += step * step
            weights += 0.5 * step / np.sqrt(w2)
            turn = seen - pairs - 1e-4 * moves
            m2 += turn * turn
            moves += 0.2 * turn / np.sqrt(m2)
    return numbers, weights, moves


def sample_islands(docs: DataFrame, text: str = "text") -> list[str]:
    """At most SAMPLE_ISLANDS island texts, from at most SAMPLE_DOCS documents, in a fixed order."""
    few = sample_texts(docs, text, SAMPLE_DOCS, lambda x: x.rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            out = []
            for x in batch.column(0).to_pylist():
                for n, (a, b) in enumerate(islands(x)):
                    if n == ISLANDS_PER_DOC:
                        break
                    if b - a <= ISLAND_CHARS:
                        out.append(x[max(0, a - 1):b + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["island"])

    found = sorted({r.island for r in few.mapInArrow(lean(cut), "island string").distinct().collect()})
    return choose(found)


def choose(found: list[str]) -> list[str]:
    shapes: dict[str, list[str]] = {}
    for x in found:
        shapes.setdefault(re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", x)), []).append(x)
    kept = [x for group in shapes.values() for x in group[:SAME_SHAPE]]
    return sorted(kept, key=lambda x: (math.log2(len(x) + 1) // 1, x))[:SAMPLE_ISLANDS]


def spans_of(text: str | None, model) -> list[dict]:
    """Base spans and the field's, by kind as listed, then start."""
    if not text or not _SEED.search(text):
        return []
    numbers, weights, moves = model
    base = base_spans(text)
    out = [(KINDS.index(k), a, b, True) for k, a, b in base]
    if len(numbers):
        zero = len(numbers)
        padded = np.vstack([weights, np.zeros((1, len(KINDS)))])
        taken = sorted((a, b) for _, a, b in base)
        for a, b in islands(text):
            island = Island(text, a, b, lambda names: [numbers.get(f, zero) for f in names])
            for kind, i, j in best(island, padded, moves):
                s, e = island.tokens[i][0], island.tokens[j][1]
                if all(e <= x or s >= y for x, y in taken):
                    out.append((kind, s, e, False))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in sorted(out)]


def find(docs: DataFrame, text: str = "text", model=None) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end, and whether a pattern (base) or the field found it."""
    model = model or fit(sample_islands(docs, text))
    kept = docs.drop("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = [spans_of(t, model) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(SPAN))], names=[*batch.schema.names, "spans"])

    schema = kept.withColumn("spans", F.lit(None).cast(SPANS_DDL)).schema
    return kept.mapInArrow(lean(run), schema)


def redact(docs: DataFrame, text: str = "text", model=None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    model = model or fit(sample_islands(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            out = [masked(t, spans_of(t, model)) for t in batch.column(text).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return docs.mapInArrow(lean(run), docs.schema)


def masked(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
