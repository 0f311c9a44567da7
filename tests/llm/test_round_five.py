"""Families of the near-duplicate join beside a passage that very many texts have, and ids put together from a store."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from gradeloom.llm import ngram_join, simple8b

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_a_common_passage_makes_no_family(spark):
    common, table = prose(1, 60), []
    for pair in range(30):  # two near copies, of which half is the passage of all
        own = prose(100 + pair, 60)
        table += [(2 * pair, f"{own} {common}"), (2 * pair + 1, f"{own} {common} end{pair}")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    alive = ngram_join.survivors(docs, 10_000).cache()
    family, _ = ngram_join.families(alive)
    assert alive.count() == 60
    assert {r["count"] for r in family.groupBy("label").count().collect()} == {2}
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {d: d - d % 2 for d, _ in table}


def test_every_batch_is_told_the_same_of_common_tokens(spark, monkeypatch):
    """A token's place in the order of rare tokens first may not hang on who else is in its batch."""
    common = prose(2, 40)
    table = [(i, f"{prose(300 + i // 2, 50)} {common}" + " x" * (i % 2)) for i in range(40)]
    for parts in (1, 3, 40):
        docs = spark.createDataFrame(table, "doc_id long, text string").repartition(parts)
        firsts = {r.cls.hex(): np.frombuffer(r.first, np.uint64).tolist() for r in ngram_join.survivors(docs, 3 * ngram_join.RANGE_TOKENS).collect()}
        assert len(firsts) == 40
        if parts == 1:
            want = firsts
        assert firsts == want


def test_slices_of_a_range_answer_as_a_whole(monkeypatch):
    texts = [f"{prose(400 + i // 3, 80)} {prose(5, 30)}" for i in range(30)]
    batches = [row for part in (texts[:12], texts[10:]) for row in pa.Table.from_batches(ngram_join._pack(1)(iter([pa.record_batch({"text": part})]))).to_pylist()]
    group = pa.Table.from_pylist([r for r in batches if r["home"] == 0], schema=ngram_join.PACKED)
    answers = []
    for slices in (1, 8):
        monkeypatch.setattr(ngram_join, "SLICES", slices)
        answers.append(ngram_join._answer(1)((pa.scalar(0),), group).to_pylist())
    assert answers[0] == answers[1] and any(r["common"] for r in answers[0])


def test_store_of_pieces_starts_anew(monkeypatch):
    """Ids stay those of the library when the stores are full in the midst of a table, and each new piece is asked for once."""
    r = random.Random(6)
    pieces = [f"{prose(i, 1)}{r.choice(['', '.', ',', chr(8212), 'é'])}{i % 97}" for i in range(600)] + ["a<|endoftext|>b", "ﬁ", "it's", ""]
    texts = [" ".join(r.choice(pieces) for _ in range(60)) for _ in range(120)] + [None, "", " "]
    encoder = simple8b.Encoder(simple8b.default_path())
    want = [ids + simple8b.END.to_bytes(4, "little") for ids in encoder.asked([t or "" for t in texts])]
    filled, fill = [], encoder.pieces.fill
    monkeypatch.setattr(encoder.pieces, "fill", lambda new: filled.extend(new) or fill(new))
    for i in range(0, len(texts), 10):
        assert encoder.encode(texts[i:i + 10]) == want[i:i + 10]
    assert len(filled) == len(set(filled))
    monkeypatch.setattr(simple8b, "ENTRIES", 200)
    for i in range(0, len(texts), 10):
        assert encoder.encode(texts[i:i + 10]) == want[i:i + 10]
    assert len(filled) > len(set(filled)) and encoder.encode([]) == []
