"""What a worker holds while it encodes pieces."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gradeloom.llm import common, piece_bpe


def test_a_batch_of_long_texts_is_encoded_in_parts():
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(4000)) for _ in range(120)), "é中▁ \n x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    path = piece_bpe.default_path()
    whole = piece_bpe.load(path).encode(texts)
    tracemalloc.start()
    got = []
    for part in piece_bpe.encoder(path)([batch]):
        got += [(i, np.array(ids, np.int32).tobytes()) for i, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1] - sum(len(ids) for _, ids in got)
    tracemalloc.stop()
    assert got == list(enumerate(whole))
    assert peak < 12e6  # a part of it; the whole batch at once is far above


def test_slices_by_bytes_lose_no_row():
    texts = ["a" * 10, None, "b" * 300, "", "é" * 45, "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for most in (1, 20, 100, 1000):
        parts = [p.column("text").to_pylist() for p in common.batches_of_bytes([batch.slice(0, 0), batch, batch.slice(3)], "text", most, 4)]
        assert sum(parts, []) == texts + texts[3:]
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
        assert all(0 < len(p) <= 4 for p in parts)


def test_memos_stay_within_their_bounds(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO_ENTRIES", 500)
    monkeypatch.setattr(piece_bpe, "PAIRS", 300)
    model, r = piece_bpe.PieceModel(piece_bpe.default_path()), random.Random(7)
    for _ in range(40):
        model.encode([" ".join("".join(r.choice("abcdeinrst") for _ in range(8)) for _ in range(200))])
        assert len(model.memo) + len(model.older) <= 2 * (500 + 201)
        assert max(map(len, (model.fits, model.steps, model.shorter))) <= 300


def test_neighbours_fit_as_merging_says():
    model, r = piece_bpe.load(piece_bpe.default_path()), random.Random(8)
    sound = [p for p in model.ids if model.merged(p) == [p]]
    pairs = [(r.choice(sound), r.choice(sound)) for _ in range(10_000)]
    pairs += [(p[:n], p[n:]) for p in sound[::4] for n in range(1, len(p)) if p[:n] in model.automaton and p[n:] in model.automaton]
    pairs += [(r.choice("a▁=-") * r.randint(1, 8), r.choice("a▁=-") * r.randint(1, 8)) for _ in range(2000)]
    pairs = [(a, b) for a, b in pairs if a in model.automaton and b in model.automaton]
    told = [model._fits(pair) for pair in pairs]
    assert told == [model.merged(a + b) == [a, b] for a, b in pairs]
    assert 0 < sum(told) < len(told)
