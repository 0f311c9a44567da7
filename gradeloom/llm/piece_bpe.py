"""Exact merge-type (BPE) encoding and decoding of SentencePiece models, by backtracking instead of merging.

A sequence of pieces is the encoding of its text exactly when every two neighbours, re-merged alone, come out as those same two
pieces (a merge across the border would happen in the pair as it does in the text). So an encoder may walk from left to right:
take the longest piece at a position (Aho-Corasick finds all matches in one pass), keep it if it is compatible with the piece
before, else try its next shorter prefix that is a piece; when none is left, mark the position as failed in a bitfield, go back one
piece and go on from there. No position fails twice, so the walk is linear in the text, and compatibility checks are remembered.

Texts are cut where no piece can reach across (before a run of the space mark, around line feeds), checked against the vocabulary
when the model is loaded; recurring cuts are encoded once per worker (a bounded memo).

Null text: as empty: no ids, decoded to an empty text. U+2581 in a text is a space to the library, and comes back as one.
Characters outside the vocabulary become byte pieces. Repeated rows, null ids, other columns: kept as they are, row by row; a text
column named otherwise can be given. Columns named ``ids`` or ``decoded`` in the input are replaced. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Memo, batches_of_bytes, documents, keeps, lean

OWNER = "piece_bpe"
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, BYTE = 1, 6
#: A worker's memo: entries of a generation (two are alive), and the longest cut kept; remembered pairs; bytes of text whose cuts are alive
#: at a time. A matter of speed and memory only: every worker may come to hold one until another operator's task.
MEMO_ENTRIES, MEMO_LENGTH, PAIRS, TEXT_BYTES = 400_000, 40, 1 << 17, 1 << 18


class PieceModel:
    """Vocabulary of one model file, read once per worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or any(p.type not in (NORMAL, BYTE, 2, 3) for p in model.pieces)):
            raise ValueError("needs a BPE model with byte fallback, a dummy prefix and no normalisation")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b""
                        for p in model.pieces]
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        if missing := {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError(f"pieces with characters that are none: {sorted(missing)[:5]}")
        cut_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        cut_line = not any("\n" in p for p in self.ids)
        self.cuts = re.compile(r" +[^ \n]*|[^ \n]+|\n" if cut_space and cut_line else r"[\s\S]+")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # a piece that merging never reaches is never an answer
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.steps = Memo(self._steps, PAIRS)
        self.fits = Memo(self._fits, PAIRS)
        self.shorter = Memo(self._shorter, PAIRS)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Let the memos go."""
        self.memo, self.older = {}, {}
        for memo in (self.steps, self.fits, self.shorter):
            memo.clear()

    def merged(self, text: str) -> list[str]:
        """Merge a short text in order of score, leftmost first."""
        parts = list(text)
        for _ in self.merges(parts):
            pass
        return parts

    def merges(self, parts: list[str]) -> Iterator[float]:
        """Merge ``parts`` in place; the score of each step."""
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            yield best

    def _steps(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]]:
        """How a piece's first part, and its last, grow while it is merged: (least score of the steps up to that change, the part
        from then on). The first entry is the part that merging begins with."""
        parts, none = list(piece), float("inf")
        heads, tails = [(none, parts[0])], [(none, parts[-1])]
        low_head = low_tail = none
        for score in self.merges(parts):
            low_head, low_tail = min(low_head, score), min(low_tail, score)
            if parts[0] != heads[-1][1]:
                heads.append((low_head, parts[0]))
                low_head = none
            if parts[-1] != tails[-1][1]:
                tails.append((low_tail, parts[-1]))
                low_tail = none
        return heads, tails

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Neighbours that come out as they are when re-merged alone; no piece reaches across a character outside the vocabulary.

        Each is merged as it would be alone, the better step first, until a merge across the border is better than both next steps
        (equal scores: leftmost first, so the left piece's step is before it and the right one's after).
        """
        if pair[0] not in self.ids or pair[1] not in self.ids:
            return True
        left, right = self.steps[pair[0]][1], self.steps[pair[1]][0]
        i = j = 0
        while True:
            across = self.scores.get(left[i][1] + right[j][1])
            one = left[i + 1][0] if i + 1 < len(left) else None
            two = right[j + 1][0] if j + 1 < len(right) else None
            if across is not None and (one is None or across > one) and (two is None or across >= two):
                return False
            if one is None and two is None:
                return True
            if two is None or (one is not None and one >= two):
                i += 1
            else:
                j += 1

    def _shorter(self, piece: str) -> str:
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton), "")

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; a character outside the vocabulary stands for itself."""
        longest = bytearray(len(text))
        for last, n in self.automaton.iter_long(text):
            longest[last - n + 1] = n
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, fits, shorter, size, put = 0, self.fits, self.shorter, len(text), out.append
        while at < size:
            n = longest[at]
            if not n:  # a place where the chain of longest matches has no start
                last, n = next(self.automaton.iter_long(text[at:at + 255]), (0, 1))
                n = longest[at] = n if last == n - 1 else 1
            piece = text[at:at + n]
            while True:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], piece]):
                    put(piece)
                    at = end
                    break
                piece = shorter[piece]
                if not piece:
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= len(piece)
        return out

    def ids_of(self, piece: str) -> bytes:
        return self.packed.get(piece) or b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode("utf-8", "surrogatepass"))

    def split(self, text: str | None) -> list[str]:
        """Cuts of a text with the dummy prefix; a space mark stands as a plain space, so that most cuts take a byte a character."""
        return self.cuts.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode_cuts(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of each cut; all cuts are walked as one text, parted by line feeds (which no piece contains)."""
        if not cuts:
            return {}
        if any("\n" in c for c in cuts):
            return {c: b"".join(map(self.ids_of, self.pieces(c.replace(" ", SPACE)))) for c in cuts}
        out, begin, pieces = {}, 0, self.pieces("\n".join(cuts).replace(" ", SPACE))
        packed = self.packed.get
        ends = [i for i, p in enumerate(pieces) if p == "\n"] + [len(pieces)]
        for cut, end in zip(cuts, ends, strict=True):
            ids = list(map(packed, pieces[begin:end]))
            out[cut] = b"".join(ids) if None not in ids else b"".join(map(self.ids_of, pieces[begin:end]))
            begin = end + 1
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        memo, older, texts = self.memo, self.older.get, [self.split(t) for t in texts]
        memo["\n"] = self.ids_of("\n")
        got = [list(map(memo.get, cuts)) for cuts in texts]
        new = {c: older(c) for cuts, ids in zip(texts, got, strict=True) if None in ids for c, i in zip(cuts, ids, strict=True) if i is None}
        new |= self.encode_cuts([c for c, i in new.items() if i is None])
        out = [b"".join(ids if None not in ids else [new[c] if i is None else i for c, i in zip(cuts, ids, strict=True)])
               for cuts, ids in zip(texts, got, strict=True)]
        if len(memo) > MEMO_ENTRIES:  # the last generation stays in reach, so frequent cuts are not lost
            self.memo, self.older = {}, memo
        self.memo.update((c, i) for c, i in new.items() if len(c) <= MEMO_LENGTH)
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids: surfaces joined (a byte piece is its byte), without the space of the dummy prefix."""
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, np.int32).tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_models: list[PieceModel] = []


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    _models.append(PieceModel(path))
    del _models[:-2]
    return _models[-1]


keeps(OWNER, lambda: [model.forget() for model in _models])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``decoded`` (the text that the ids decode to)."""
    path = path or default_path()
    kept = docs.drop("ids", "decoded")
    schema = kept.withColumn("ids", F.array(F.lit(0))).withColumn("decoded", F.lit("")).schema

    return kept.mapInArrow(lean(encoder(path, text), OWNER), schema)


def encoder(path: str, text: str = "text"):
    """Batches with a column ``text`` to smaller ones with ``ids`` and ``decoded``, few of whose cuts are alive at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches_of_bytes(batches, text, TEXT_BYTES):
            blobs = model.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([model.decode(b) for b in blobs], pa.string())],
                                             names=[*batch.schema.names, "ids", "decoded"])

    return run


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 of what ``encode`` returns."""
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir).select("doc_id", "text")), "doc_id")
