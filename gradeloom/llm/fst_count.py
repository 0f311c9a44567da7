"""Token counts of a byte-level BPE tokenizer by finite-state transducers compiled from its file, without tokenizing.

Two deterministic machines are composed:

* ``Splitter``: the pre-tokenizer's pattern as an automaton over character classes (``STATES`` x ``CLASSES``, one dense table). Its
  transitions say whether a pre-token begins at this character or began at the one before, so the pattern's look-ahead costs one
  character of delay. A block of text is cut into chunks; every chunk's *state map* (exit state for every entry state) is taken
  for all chunks at once, the maps are composed by a parallel prefix scan, and the entry states it gives let all chunks emit together.
* ``Counter``: a transducer over the bytes of a pre-token whose transitions carry the change of the token count. Its state is what can
  still matter of the text behind: the longest suffix that begins some token, with the last token and the relative count at each
  place in it. The last token at a place is the longest one ending there that is compatible with the last token where it begins
  (two tokens are compatible when re-merging them alone gives the same two), so the weights of a path add up to the exact count.
  States are compiled when first reached (bounded table, started anew when full); no two texts of one state are told apart.

Null or empty text: no tokens. The tokenizer's special strings count one and end the text before them, as in the library. Texts of any length
are read in blocks of ``BLOCK`` characters or one text. Null and repeated ids, repeated rows: row by row. Extra columns stay, a column
named ``n_tokens`` is replaced. Empty table: empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Memo, batches_of, documents

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Characters of a block, and of a chunk in it. A matter of speed and memory only.
BLOCK, CHUNK = 1 << 20, 128
#: Entries of a worker's tables and the longest pre-token kept in its memo. A matter of speed and memory only.
MEMO_ENTRIES, MEMO_LENGTH, TRANSITIONS = 300_000, 48, 600_000

CLASSES = LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, ENDS, RE, E, EL, STOP = range(11)
STATES = BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, SPACE_2, WHITE_1, WHITE_2, QUOTED, QUOTED_RE, QUOTED_EL = range(11)
UNKNOWN = 255
#: Fixed by the pattern: the letters of its contractions 's 't 'm 'd, 're 've, 'll.
CONTRACTION = {"s": ENDS, "t": ENDS, "m": ENDS, "d": ENDS, "r": RE, "v": RE, "e": E, "l": EL}
LETTERS = {LETTER, ENDS, RE, E, EL}
RUN = {LETTER: IN_LETTERS, ENDS: IN_LETTERS, RE: IN_LETTERS, E: IN_LETTERS, EL: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS,
       QUOTE: IN_OTHERS}
HERE, BEFORE = 1, 2
NEVER = 1 << 60


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state, and marks: a pre-token begins HERE, or began at the character BEFORE this one."""
    if state in (QUOTED_RE, QUOTED_EL):
        if (state, c) in ((QUOTED_RE, E), (QUOTED_EL, EL)):
            return BEGIN, 0
        after, marks = _step(IN_LETTERS, c)  # no contraction after all: the quote stands alone, letters began one before
        return after, marks | BEFORE
    if c == STOP:
        return BEGIN, HERE
    if c in (SPACE, WHITE):
        if state in (SPACE_1, SPACE_2, WHITE_1, WHITE_2):
            return (SPACE_2 if c == SPACE else WHITE_2), 0
        return (SPACE_1 if c == SPACE else WHITE_1), HERE
    late = BEFORE if state in (SPACE_2, WHITE_2) else 0  # the last white space of a run leaves it
    if state in (SPACE_1, SPACE_2):
        return RUN[c], late
    if state in (BEGIN, WHITE_1, WHITE_2):
        return (QUOTED if c == QUOTE else RUN[c]), HERE | late
    if state == QUOTED:
        if c in (ENDS, RE, EL):
            return {ENDS: BEGIN, RE: QUOTED_RE, EL: QUOTED_EL}[c], 0
        return (IN_OTHERS, 0) if c in (OTHER, QUOTE) else (RUN[c], HERE)
    if RUN[c] == state:
        return state, 0
    return (QUOTED if c == QUOTE else RUN[c]), HERE


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, row by row: entry state to exit state of ``first`` and ``then`` in sequence."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of a column of state maps, in log2(n) rounds over all of them."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        maps[width:] = compose(maps[:-width], maps[width:])
        width *= 2
    return maps


class Splitter:
    """Pre-token starts in a block of text."""

    def __init__(self, pretokenize):
        self.pretokenize = pretokenize
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        steps = [[_step(s, c) for c in CLASSES] for s in STATES]
        self.next = np.array([[n for n, _ in row] for row in steps], np.uint8).ravel()
        self.marks = np.array([[m for _, m in row] for row in steps], np.uint8).ravel()

    def learn(self, points: np.ndarray) -> None:
        """The class of code points met for the first time, asked of the library's own pre-tokenizer."""
        for p in np.unique(points).tolist():
            c = chr(p)
            alone = {k: len(self.pretokenize(lead + c)) == 1 for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))}
            kind = next((k for k, one in alone.items() if one), SPACE if c == " " else WHITE)
            self.classes[p] = QUOTE if c == "'" else CONTRACTION.get(c, kind)

    def starts(self, text: str, stops: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin; ``stops`` are positions of characters that part texts (they count as starts)."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        if (new := classes == UNKNOWN).any():
            self.learn(points[new])
            classes = self.classes[points]
        classes[stops] = STOP
        size = len(classes)
        chunks = np.full(-(-size // CHUNK) * CHUNK, STOP, np.uint8)
        chunks[:size] = classes
        columns = np.ascontiguousarray(chunks.reshape(-1, CHUNK).T).astype(np.int32)
        width = len(CLASSES)
        maps = np.tile(np.arange(len(STATES), dtype=np.uint8), (columns.shape[1], 1))
        for column in columns:
            maps = self.next[maps * np.int32(width) + column[:, None]]
        entry = np.concatenate([[BEGIN], scan(maps)[:-1, BEGIN]])
        marks = np.empty(columns.shape, np.uint8)
        for j, column in enumerate(columns):
            edge = entry * np.int32(width) + column
            marks[j], entry = self.marks[edge], self.next[edge]
        marks = marks.T.ravel()
        begins = marks & HERE
        begins[:-1] |= marks[1:] >> 1
        return np.flatnonzero(begins[:size])


class Counter:
    """Transducer over bytes: ``count`` adds the weights along the path of one pre-token."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        #: canonical token to (left, right, rank) of the merge that makes it; bytes are made by none
        self.made: dict[bytes, tuple | None] = {bytes([b]): None for b in range(256)}
        self.spines: dict[bytes, tuple] = {}
        for i, (left, right) in enumerate(merges):
            if left not in self.made or right not in self.made:
                continue  # merging never has both parts at hand
            if left + right not in self.made and self.crossing(left, right) == (left, right):
                self.made[left + right] = (left, right, i)
        self.tokens = self.made.keys()
        self.heads = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.fits = Memo(lambda pair: self.crossing(*pair) is None)
        self.forget()

    def spine(self, token: bytes, side: int) -> tuple[tuple[bytes, int], ...]:
        """The parts of ``token`` at its left (0) or right (1) edge, each with the rank of the merge that takes it up, smallest part first."""
        parts, taken = [], NEVER
        while token:
            parts.append((token, taken))
            step = self.made[token]
            token, taken = (step[side], step[2]) if step else (b"", 0)
        return tuple(reversed(parts))

    def crossing(self, left: bytes, right: bytes) -> tuple[bytes, bytes] | None:
        """The first merge across the border of two tokens, if any: its parts stand at the border before either is taken up.

        Every merge uses tokens of earlier merges only, so merging in order of rank never comes back to a lower rank, and a part
        is there from its own merge until the one that takes it up; of two merges of one rank the left one comes first.
        """
        edges = self.spines.get(left) or self.spines.setdefault(left, (self.spine(left, 0), self.spine(left, 1)))
        others = self.spines.get(right) or self.spines.setdefault(right, (self.spine(right, 0), self.spine(right, 1)))
        best, rank = None, self.rank.get
        for a, taken in edges[1]:
            for b, gone in others[0]:
                r = rank((a, b), NEVER)
                if r < taken and r <= gone and r < NEVER and (best is None or r < best[0]):
                    best = r, (a, b)
        return best and best[1]

    def forget(self) -> None:
        #: edges: state << 8 | byte to next state << 9 | weight + 256; a state is (suffix, last tokens, counts) at 0..len(suffix)
        start = (b"", (None,), (0,))
        self.edges: dict[int, int] = {}
        self.states, self.numbers = [start], {start: 0}

    def compile(self, state: int, byte: int) -> int:
        suffix, last, counts = self.states[state]
        longer, heads, tokens, fits = suffix + bytes([byte]), self.heads, self.tokens, self.fits
        cut = begin = 0
        while longer[cut:] not in heads:  # a byte alone is a token
            cut += 1
        for begin in range(cut, len(longer)):
            token = longer[begin:]
            if token in tokens and (last[begin] is None or fits[last[begin], token]):
                break
        total = counts[begin] + 1
        reached = (longer[cut:], (*last[cut:], token), (*[c - total for c in counts[cut:]], 0))
        number = self.numbers.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        edge = self.edges[state << 8 | byte] = number << 9 | (total - counts[-1] + 256)
        return edge

    def count(self, data: bytes) -> int:
        if len(self.edges) > TRANSITIONS:
            self.forget()
        state, total, edges = 0, -256 * len(data), self.edges.get
        for byte in data:
            edge = edges(state << 8 | byte) or self.compile(state, byte)
            state = edge >> 9
            total += edge & 511
        return total


class TokenCounts:
    """Both machines of one tokenizer file, compiled once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if (model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix") or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)):
            raise ValueError("needs a byte-level BPE file with its own pattern, no normaliser and plain added tokens")
        byte_of = self.alphabet(ByteLevel(add_prefix_space=False, use_regex=False))

        def raw(piece: str) -> bytes:
            return bytes(byte_of[c] for c in piece)

        special = {t["content"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges, born = [(raw(a), raw(b)) for a, b in pairs], {}
        for i, (a, b) in enumerate(merges):
            born.setdefault(a + b, i)
        if len(byte_of) != 256 or any(c not in model["vocab"] for c in byte_of):
            raise ValueError("needs a token for every byte")
        if any(len(part) > 1 and born.get(part, NEVER) >= i for i, pair in enumerate(merges) for part in pair):
            raise ValueError("needs merges of parts that earlier merges make")
        self.counter = Counter(merges)
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        # the longest special string at a place wins, as in the library
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.memo = Memo(lambda piece: self.counter.count(piece.encode("utf-8", "surrogatepass")), MEMO_ENTRIES)

    @staticmethod
    def alphabet(plain) -> dict[str, int]:
        """The byte that each letter of the byte alphabet stands for, read off the library's output for texts of known bytes."""
        out: dict[str, int] = {}
        for p in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x400)]:
            out.update(zip("".join(s for s, _ in plain.pre_tokenize_str(chr(p))), chr(p).encode(), strict=True))
        # bytes that no text holds keep the letters left over, in order
        left = [b for b in range(256) if b not in out.values()]
        return out | dict(zip(sorted(set(plain.alphabet()) - out.keys()), left, strict=True))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts = (self.special.split(text) if self.special else [text]) if text else []
            totals[i] += max(len(parts) - 1, 0)
            for part in parts:
                if part:
                    pieces.append(part)
                    owners.append(i)
                    size += len(part)
            if size > BLOCK:
                self._block(pieces, owners, totals)
                pieces, owners, size = [], [], 0
        self._block(pieces, owners, totals)
        return totals

    def _block(self, pieces: list[str], owners: list[int], totals: np.ndarray) -> None:
        if not pieces:
            return
        text = "\0".join(pieces) + "\0"
        stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
        starts = self.splitter.starts(text, stops)
        where, memo, count = starts.tolist(), self.memo, self.counter.count
        tokens = [text[a:b] for a, b in zip(where, where[1:], strict=False)]
        counts = np.fromiter((memo[t] if len(t) <= MEMO_LENGTH else count(t.encode("utf-8", "surrogatepass")) for t in tokens), np.int64, len(tokens))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.searchsorted(starts, stops)  # the stop's own one-character piece is left out
        begins = np.concatenate([[0], ends[:-1] + 1])
        np.add.at(totals, owners, sums[ends] - sums[begins])


@lru_cache(maxsize=2)
def load(path: str) -> TokenCounts:
    return TokenCounts(path)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens long``: the tokens of ``text`` without begin, end or added special tokens."""
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    kept = docs.drop("n_tokens")
    schema = kept.withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches_of(batches):
            counts = machine.count(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, "n_tokens"])

    return kept.mapInArrow(run, schema)


def op12_fst_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > LIMIT).alias("over_limit"))
