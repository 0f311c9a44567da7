"""What a worker holds after its tasks, and pieces that are looked up once a batch."""

from __future__ import annotations

import random

import pyarrow as pa

from gradeloom.llm import common, ngram_join, piece_bpe, simple8b


def test_a_batch_looks_each_different_piece_up_once(monkeypatch):
    r = random.Random(3)
    pieces = ["the", "The", "it's", "naïve", "ﬁ", "a<|endoftext|>b", "x\ry", "", "12.5", "中"] + ["".join(r.choice("abcde") for _ in range(5)) for _ in range(40)]
    texts = ["".join(r.choice(pieces) + r.choice(" \n") for _ in range(80)) for _ in range(60)] + [None, "", "\n", "  "]
    encoder = simple8b.Encoder(simple8b.default_path())
    want = [ids + simple8b.END.to_bytes(4, "little") for ids in encoder.asked([t or "" for t in texts])]
    asked, numbers = [], encoder.pieces.numbers
    monkeypatch.setattr(encoder.pieces, "numbers", lambda keys: asked.append(keys) or numbers(keys))
    batch = pa.array(texts, pa.string())
    assert encoder.encode(batch) == want and encoder.encode(batch.slice(30)) == want[30:] and encoder.encode(batch.slice(60)) == want[60:]
    assert len(asked) == 3 and all(len(keys) == len(set(keys)) for keys in asked)


def test_a_task_lets_go_what_other_operators_kept(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    model = piece_bpe.load(piece_bpe.default_path())
    batches = [pa.RecordBatch.from_arrays([pa.array(["one two", "three"])], names=["text"])] * 3
    same = lambda batches: iter(batches)
    model.encode(["one two three"])
    ngram_join.shingles("one two three")
    assert list(common.lean(same, piece_bpe.OWNER)(batches)) == batches and len(given) == 4
    assert model.memo and not ngram_join._word_hash
    before = model.encode(["one two three"])
    assert list(common.lean(same)([])) == [] and not (model.memo or model.older or model.fits)
    assert model.encode(["one two three"]) == before


def test_freed_memory_goes_after_large_groups(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    monkeypatch.setattr(common, "LARGE_GROUP", 100)
    seen = common.lean_group(lambda key, group: group.append_column("key", pa.array([key[0]] * len(group))))
    for n in (0, 5, 50):
        assert seen((7,), pa.table({"x": range(n)})).to_pydict() == {"x": list(range(n)), "key": [7] * n}
    assert len(given) == 1
