"""Finite-state token counts, spelling variants and pair-bound search, each against a library or brute force."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import fst_count, pair_maxscore, spelling

DOCS = "doc_id long, text string, source string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(fst_count.TOKENIZER))


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PARTS = [*"aabcdestmrvl''  \n\t.,!19", "'s", "'re", "'ve", "'ll", "the", "ing", " ", " ", "é", "ñ", "中", "😀", "　", "²", "<|endoftext|>", "<|end",
         "\0", "\x1c", "\x85", "-----", "    "]


def test_counts_equal_the_library(library):
    rnd = random.Random(7)
    machine = fst_count.load(public_tokenizers.path(fst_count.TOKENIZER))
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 2, 5, 30, 300]))) for _ in range(4000)]
    assert machine.count(texts).tolist() == lengths(library, texts)


def test_chunks_and_blocks_of_any_size_agree(library, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 3, 200]))) for _ in range(300)]
    want = lengths(library, texts)
    for block, chunk, edges in ((1, 1, 10), (50, 3, 1000), (1 << 20, 7, 600_000)):
        monkeypatch.setattr(fst_count, "BLOCK", block)
        monkeypatch.setattr(fst_count, "CHUNK", chunk)
        monkeypatch.setattr(fst_count, "TRANSITIONS", edges)
        machine = fst_count.TokenCounts(public_tokenizers.path(fst_count.TOKENIZER))
        assert machine.count(texts).tolist() == want


def test_prefix_scan_is_sequential_composition():
    import numpy as np

    maps = np.random.default_rng(1).integers(0, 11, (37, 11)).astype(np.uint8)
    got, state = fst_count.scan(maps), 5
    for i, step in enumerate(maps):
        state = step[state]
        assert got[i, 5] == state


def test_count_tokens_rows(spark, library):
    long = "erndthe " * 40_000 + "x" * 300_000
    rows = [(1, None, "a", 9), (None, "", "a", None), (None, " it's  a\n\n test ", None, 1), (2, long, "b", 2), (2, long, "b", 2)]
    got = fst_count.count_tokens(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "source", "n_tokens"] and dict(got.dtypes)["n_tokens"] == "bigint"
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    found = sorted([(r.doc_id, r.text, r.n_tokens) for r in got.collect()], key=key)
    assert found == sorted([(i, t, n) for (i, t, *_), n in zip(rows, lengths(library, [r[1] for r in rows]), strict=True)], key=key)
    assert fst_count.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_op12_equals_the_library_on_the_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(docs, lengths(library, [r.text for r in docs]), strict=True))
    assert sorted(map(tuple, fst_count.op12_fst_counts(spark, "/root/testdata/sf0.001").collect())) == want


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts: dict[str, int]) -> list[tuple]:
    out, form = {}, {}
    for word, n in counts.items():
        near = [(-counts[o], o) for o in counts if one_edit(word, o)]
        form[word] = min(near)[1] if near and -min(near)[0] >= 10 * n else None
        out[word] = (n, len(near))
    rows = []
    for word, (n, near) in out.items():
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, form[word], root, n, near, counts.get(form[word])))
    return sorted(rows)


@pytest.mark.parametrize("dictionary", [4, 40, 1 << 16])
def test_variants_equal_brute_force(spark, monkeypatch, dictionary):
    """Few letters and a coarse or fine dictionary: long grams, words without a positive bound, forms of forms."""
    monkeypatch.setattr(spelling, "DICTIONARY", dictionary)
    rnd = random.Random(dictionary)
    counts = {}
    for _ in range(120):
        word = "".join(rnd.choice("aabbé") for _ in range(rnd.randrange(7, 12)))
        counts[word] = rnd.choice([2, 3, 20, 30, 400])
        for _ in range(4):
            i, c = rnd.randrange(len(word) + 1), rnd.choice("abé")
            word = rnd.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word[:i] + word[i + 1:]])
            if len(word) >= 7:
                counts.setdefault(word, rnd.choice([2, 3, 20, 30, 400]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_variants(counts)


def test_gram_bounds_hold_for_every_edit():
    """Whatever the edit, a word keeps as many grams as its bound says, at the same distance from the start or the end."""
    rnd = random.Random(3)
    over = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 5))): 9 for _ in range(40)}
    over |= {g[:n]: 9 for g in list(over) for n in range(2, len(g))}
    d = spelling.Dictionary(over)
    for _ in range(400):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(7, 12)))
        grams = d.grams(word)
        bound = d.bound(word, grams)
        for i in range(len(word) + 1):
            for other in {word[:i] + c + word[i + k:] for c in ("a", "b", "c", "z", "") for k in (0, 1)} - {word}:
                if one_edit(word, other):
                    have = {(other[b:e], b) for b, e, _ in d.grams(other)}
                    back = {(g, b - len(other)) for g, b in have}
                    kept = sum((word[b:e], b) in have or (word[b:e], b - len(word)) in back for b, e, _ in grams)
                    assert kept >= len(grams) - bound, (word, other)


def test_words_and_edges(spark):
    import zlib

    rows = [(1, "Straße STRASSEN strassen", "a", 1), (None, "strassen", "a", 1), (2, None, "b", 1), (2, "", "b", 1), (2, "ÀBCDEFGH x7 \u0100abcdefg", "b", 1)]
    rows += [(i, "variant" * 1000 + " longword", "c", 1) for i in range(40)]
    want = {}
    for i, text, *_ in rows:
        import re
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], DOCS))).count() == 0
    assert spelling.variants(spark.createDataFrame([("abcdefg", 5)], "word string, n long")).collect()[0].root == "abcdefg"


def brute_ranking(docs, items, k):
    """item_id, rank, doc_id, score by the formula, over all documents; equal rows of items once."""
    import math
    import re

    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    held = [(i, t) for i, text, *_ in docs if (t := terms(text))]
    n, size, out = len(held), sum(len(t) for _, t in held), []
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for item, text, *_ in set(items):
        scored = []
        for i, t in held:
            m = 75 + 25 * len(t) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 12 * m))
                        for w in terms(text) if w in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("tokens", "terms"), [(1, 1), (60, 8), (1 << 21, 1 << 16)])
def test_ranking_equals_brute_force(spark, monkeypatch, tokens, terms):
    """Shards and blocks of any size, common words (weight near 0), equal texts (ties), nulls, repeated ids and extra columns."""
    monkeypatch.setattr(pair_maxscore, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(pair_maxscore, "BLOCK_TERMS", terms)
    rnd = random.Random(tokens)
    words = [*"abcdefghij", "The", "é1", "über"]
    text = lambda top: " ".join(rnd.choice(words[-rnd.randrange(1, 14):]) for _ in range(rnd.randrange(1, top)))
    docs = [(i, text(40), "a", 0) for i in range(120)] + [(900 + i, "the The b", "b", 0) for i in range(30)]
    docs += [(None, "the über", "b", 0), (None, None, "b", 1), (5, "", "b", 1), (7, "?! \n", "b", 1), (8, "über-über " * 900, "b", 1)]
    items = [(i, text(12)) for i in range(12)] + [(3, "the the b"), (3, "the the b"), (50, None), (51, ""), (None, "über"), (52, "nowhere")]
    got = pair_maxscore.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k=7)
    found = sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()], key=str)
    assert found == brute_ranking(docs, items, 7)


def test_pair_bounds_tighten_and_hold():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 6)
        rows = [[rnd.choice([0, 0, rnd.randrange(9)]) for _ in range(n)] for _ in range(12)]
        tops = [max(r[i] for r in rows) for i in range(n)]
        joint = [None] + [max([r[i - 1] + r[i] for r in rows if r[i - 1] and r[i]], default=0) for i in range(1, n)]
        bounds = pair_maxscore.prefix_bounds(tops, joint)
        for j in range(n + 1):
            assert max(sum(r[:j]) for r in rows) <= bounds[j] <= sum(tops[:j])
    assert pair_maxscore.prefix_bounds([5, 5, 2], [None, 6, None]) == [0, 5, 6, 8]


def test_ranking_of_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert pair_maxscore.ranked(none, items).count() == 0
    assert pair_maxscore.ranked(spark.createDataFrame([(1, "a b", "x", 0)], DOCS), items.where("false")).count() == 0
