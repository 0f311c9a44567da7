"""Training-data operators on texts: brute force, edge rows, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import license_scan, mixing, ngram_join, pii_crf, piece_bpe, quality_cascade, simple8b

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, ids string, cls string, hash string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(2, 30_000)
    texts = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), base.upper(), long, long + " tail",
             "mail a.b@c.de or +1 (366) 555-9807 card 4387513035237269 ip 10.0.0.1 and 999.1.1.1", "x" * 5000, "é▁ü  \U0001d11e\n\n",
             "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. CC-BY all rights reserved",
             "\n".join(["same line here"] * 40), prose(3, 200)]
    out = [(i, t, "en", "big" if i % 3 else None, 0) for i, t in enumerate(texts)]
    out += [(5, base, "en", "big", 0), (None, None, None, None, None), (None, base, None, "tiny", None), (None, "lone text of a few words", None, "tiny", 1)]
    return [(*r, "k", "s", "i", "c", "h") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_quality(spark, docs, none):
    got = quality_cascade.cascade(docs, measures=quality_cascade.MEASURES).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i:i + 8]), []).append(i)
        cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert tuple(r[m] for m in quality_cascade.MEASURES) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_cascade.cascade(none).count() == 0
    short = {(r.doc_id, r.text): r.kept for r in quality_cascade.cascade(docs).collect()}
    assert short == {(r.doc_id, r.text): r.kept for r in got}


def test_cascade_orders_by_rejection_per_cost():
    slow = quality_cascade.Rule("slow", lambda t: sum(range(20_000)) < 0)
    fast = quality_cascade.Rule("fast", lambda t: True)
    assert [e.rule.name for e in quality_cascade.estimate(["a"] * 20, (slow, fast))] == ["fast", "slow"]


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    got = piece_bpe.encode(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        want = lib.encode(r.text or "")
        assert r.ids == want and r.decoded == lib.decode(want)
    assert piece_bpe.encode(none).count() == 0
    d = piece_bpe.digests(piece_bpe.encode(docs.where("doc_id = 11")), "doc_id").first()
    want = lib.encode(rows()[11][1])
    assert d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert d.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    model, r = piece_bpe.load(piece_bpe.default_path()), random.Random(4)
    texts = ["".join(r.choice("abcde th in▁  \n\t.é中あ€𝄞") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for text, blob in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(blob, np.int32).tolist() == lib.encode(text)


def brute_links(table):
    sets = []
    for _, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(table)):
        groups.setdefault(find(i), []).append(table[i][0])
    return sets, [min((d for d in groups[find(i)] if d is not None), default=None) if sets[i] else table[i][0] for i in range(len(table))]


def check_links(df, table):
    sets, want = brute_links(table)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((t[0], len(s), w) for t, s, w in zip(table, sets, want, strict=True)), key=repr)


def test_near_duplicates(spark, docs, none):
    check_links(docs, [(r[0], r[1]) for r in rows()])
    assert ngram_join.near_duplicates(none).count() == 0


def test_near_duplicates_in_families_and_chains(spark, monkeypatch):
    r, table = random.Random(9), []
    for family in range(6):
        base = prose(100 + family, 90).split()
        for _ in range(25):
            text = list(base)
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = f"x{r.randrange(10 ** 6)}"
            table.append((len(table), " ".join(text)))
    text = prose(50, 60).split()
    for step in range(25):  # a chain: neighbours are alike, the ends are not
        text = [*text[2:], f"c{step}", f"d{step}"]
        table.append((len(table), " ".join(text)))
    shared = prose(77, 40)
    table += [(len(table) + i, f"{shared} {prose(200 + i, 60)}") for i in range(40)]
    r.shuffle(table)
    monkeypatch.setattr(ngram_join, "BATCH_TOKENS", 700)
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 3000)
    far = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    check_links(far, table)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)  # several blocks per family, some of joined classes alone
    check_links(far, table)


def test_filters_are_intersected_before_sets_are_compared(monkeypatch):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 400, 60).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.r_[s[:-2], [np.uint64(1000 + i)]]) for i, s in enumerate(sets[:10])]
    sizes, every = np.array([len(s) for s in sets]), np.arange(len(sets))
    seen, whole = [], ngram_join._meetings
    monkeypatch.setattr(ngram_join, "_meetings", lambda t, o, n, left, right: seen.append((len(left), len(right))) or whole(t, o, n, left, right))
    got = ngram_join.linked(sizes, sets, every, every, every)
    want = [[i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert got.tolist() == want and any(map(any, want))
    assert len(seen) == 3 and seen[0] >= seen[1] >= seen[2] and not ngram_join.linked(sizes, sets, every, every, 0 * every).any()
    for values in (sets[0], np.array([0, 2**63, 2**64 - 1], np.uint64), np.array([7], np.uint64)):
        assert ngram_join.unsqueeze(ngram_join.squeeze(values)).tolist() == values.tolist()


def test_tasks_that_hold_the_same_texts(spark):
    common, a = prose(60, 70), f"{prose(61, 60)} "
    b = f"{prose(62, 60)} "
    table = [(i, (a if i < 3 else b) + common) for i in range(6)]  # alike by about a third
    far = spark.createDataFrame(spark.sparkContext.parallelize(table, len(table)), "doc_id long, text string")
    check_links(far, table)
    assert {r.component_id for r in ngram_join.near_duplicates(far).collect()} == {0, 3}


def test_flushes_that_hold_the_same_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "BATCH_TOKENS", 10)
    text = prose(63, 40)
    packed = pa.Table.from_batches(ngram_join._pack(1)(iter([pa.record_batch({"text": [text, text]})]))).to_pylist()
    assert len({r["batch"] for r in packed}) == sum(r["sizes"] is not None for r in packed) == 2


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii_crf.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    for _ in range(8000):
        t = "".join(r.choice("0123 456.-@+()ab%٣\n") for _ in range(r.randint(0, 30)))
        assert pii_crf.base_spans(t) == plain_spans(t)


def test_field_finds_the_best_labelling():
    """Dynamic programming against every labelling of a short island; expectations against their sums."""
    import itertools
    import math

    text, numbers = "+1 (36 10.1", {}
    island = pii_crf.Island(text, 0, len(text), lambda names: [numbers.setdefault(f, len(numbers)) for f in names])
    g = np.random.default_rng(5)
    w, m = g.standard_normal((len(numbers), 4)), g.standard_normal((5, 5))
    table, n, found = pii_crf.scores(island, w), len(island.tokens), {}

    def grow(at, labels):
        if at == n:
            score, y = 0.0, 0
            for (i, j, k) in labels:
                score += m[y, k] + (table[i, j][k - 1] if k else 0)
                y = k
            found[tuple(labels)] = score
            return
        grow(at + 1, [*labels, (at, at, 0)])
        for j, k in itertools.product(range(at, n), range(1, 5)):
            if (at, j) in table:
                grow(j + 1, [*labels, (at, j, k)])

    grow(0, [])
    top = max(found, key=found.get)
    assert pii_crf.best(island, w, m) == [(k - 1, i, j) for i, j, k in top if k]
    total = math.log(sum(math.exp(s) for s in found.values()))
    used, _ = pii_crf.expectations(island, w, m)
    for (i, j, k), p in used.items():
        assert abs(p - sum(math.exp(s - total) for x, s in found.items() if (i, j, k) in x)) < 1e-9


def test_personal_data(spark, docs, none):
    got = pii_crf.find(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_spans(r.text or "")
    hidden = {r.doc_id: r.text for r in pii_crf.redact(docs).collect()}
    assert "4387513035237269" not in hidden[11] and "<CARD>" in hidden[11] and "<EMAIL>" in hidden[11] and hidden[17] == rows()[17][1]
    assert pii_crf.find(none).count() == 0 and pii_crf.redact(none).count() == 0


def test_simple8b_round_trip():
    g = np.random.default_rng(0)
    for k in range(200):
        ids = g.integers(0, 2 ** int(g.integers(1, 32)), int(g.integers(0, 700))).astype(np.uint32)
        if k % 3 == 0:
            ids = np.where(g.random(len(ids)) < .9, 0, ids).astype(np.uint32)
        words, escapes = simple8b.pack(ids)
        assert len(words) % 8 == 0 and (simple8b.unpack(words, escapes, len(ids)) == ids).all()


def test_token_ids_are_the_librarys():
    import random

    import public_tokenizers

    r = random.Random(5)
    signs = "aAzZ09'stredvml .,!?<|>endoftexstar\n\t\x1c\x85 éÉßÿ×÷ªµ’“—…İıǆ٣é一Σσς\u200b\u0301"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "It'S don'T 's''s", "", "x" * 50_000, "'" * 3000, " \n "]
    for name, by_pieces in ((simple8b.TOKENIZER, True), ("byte_bpe_50k.json", False)):
        encoder = simple8b.Encoder(public_tokenizers.path(name))
        assert encoder.by_pieces is by_pieces
        end = simple8b.END.to_bytes(4, "little")
        assert encoder.encode(texts) == [ids + end for ids in encoder.asked(texts)] == encoder.encode(texts)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(simple8b.default_path())
    blocks = simple8b.write(docs, partitions=3)
    got = (simple8b.documents_of(blocks, with_ids=True).join(simple8b.starts_of(blocks), ["shard", "block"])
           .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids").orderBy("start").collect())
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows()], key=lambda d: (d is not None, d or 0))
    assert sorted(map(tuple, (r.ids for r in got))) == sorted((*lib.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows())
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    crc = {(r.shard, r.block, r.nth): r.ids_crc32 for r in simple8b.documents_of(blocks).collect()}
    for r in simple8b.documents_of(blocks, with_ids=True).collect():
        assert crc[r.shard, r.block, r.nth] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert simple8b.documents_of(simple8b.write(none)).count() == 0


def test_mixture(spark, docs, none):
    many = spark.createDataFrame([(i, prose(i, 20 + i % 7), "big" if i % 10 else f"s{i % 3}", "x") for i in range(900)],
                                 "doc_id long, text string, source string, slot string")
    got = mixing.mix(many, entropy_share=0.99, max_repeats=3.0).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.source, []).append(r)
    copies = {s: len(v) / len({r.doc_id for r in v}) for s, v in tokens.items()}
    assert copies["big"] == 1.0 and all(2.5 < c <= 3.0 for s, c in copies.items() if s != "big")
    assert {r.doc_id for r in got} == set(range(900))
    for v in tokens.values():  # a permutation per epoch, without gaps in the running sum
        v.sort(key=lambda r: r.start_tokens)
        assert [r.start_tokens for r in v] == np.cumsum([0, *(r.n_tokens for r in v)])[:-1].tolist()
        assert all(0 <= r.slot < 1 for r in v)
    cut = mixing.mix(many, entropy_share=0.8, budget_tokens=4000).agg(F.sum("n_tokens")).first()[0]
    assert 3500 < cut <= 4000
    every = mixing.mix(docs)
    assert every.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() >= 0
    assert docs.select("doc_id", "text").exceptAll(every.select("doc_id", "text")).count() == 0
    assert mixing.mix(none).count() == 0


def test_license_labels(spark, docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect() if r.doc_id is not None}
    assert got[14].labels == "gpl" and got[14].n_base == 1 and got[14].first_word == got[14].last_word == 7
    assert got[15].base_labels == "cc-by,reserved" and got[15].n_base == 3 and (got[15].first_word, got[15].last_word) == (0, 5)
    assert got[0].n_words == 0 and got[0].labels == "" and got[17].score == 0.0
    assert license_scan.scan(docs).count() == len(rows()) and license_scan.scan(none).count() == 0
    broken = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to any person (or body) obtaining a copy of this software and "
                                        "associated documentation files")], "doc_id long, text string")
    assert license_scan.scan(broken).first().labels == "mit"  # a shifted diagonal is merged


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("Creative Commons Attribution-Non-Commercial-No Derivatives 3.0", "cc-by-nc-nd"),
    ("Creative Commons Attribution Share Alike", "cc-by-sa"),
    ("see CC BY-SA 3.0 here", "cc-by,cc-by-sa"), ("under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),  # the base phrase stands in both
    ("This work is licensed under the GNU Lesser General Public License version 3", "gpl,lgpl"),  # as here
    ("Creative things and commons", ""),
])
def test_qualified_licenses(spark, text, labels):
    got = license_scan.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r.labels for r in got] == [labels] * 2


def test_mixture_keeps_columns_that_clash(spark):
    names = ("quota", "before", "order", "t", "of", "in_0", "mix_row", "turn")
    table = spark.createDataFrame([(i, f"some words {i}", f"s{i % 2}", "kept", *(f"{n}{i}" for n in names)) for i in range(40)],
                                  "doc_id long, text string, source string, N_TOKENS string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(table)
    assert got.columns == ["doc_id", "text", "source", *names, *mixing.RESULTS]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names) and got.count() >= 40


def test_samples_are_bounded_and_distinct(spark):
    from gradeloom.llm.common import sample_texts

    table = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = [r.text for r in sample_texts(table, "text", 50).collect()]
    assert len(set(got)) == len(got) == 50
    assert sample_texts(table.where("text = 'copy'"), "text", 50).count() <= 1 and sample_texts(table.limit(0), "text", 50).count() == 0


def test_pipeline_keeps_columns_and_rows(spark, docs, none):
    import corpus_pipeline

    for table in (docs, none):
        at = table.select(*corpus_pipeline.COLUMNS)
        for _, step in corpus_pipeline.STAGES[:-1]:
            at = step(spark, at, "unused")
            assert tuple(at.columns) == corpus_pipeline.COLUMNS
        last = corpus_pipeline.STAGES[-1][1](spark, at, "unused").collect()
        if table is none:
            assert not last
            continue
        texts = [(r[0], quality_cascade.Text(r[1])) for r in rows()]
        kept = [(i, t.text) for i, t in texts if not any(rule.rejects(t) for rule in quality_cascade.RULES)]
        _, comps = brute_links(kept)
        assert {r.doc_id for r in last} == set(comps)


def near_of(seed, n, at):
    words = prose(seed, n).split()
    words[at] = "changed"
    return " ".join(words)


def test_one_row_per_group_and_no_group_lost(spark):
    import corpus_pipeline

    texts = {i: prose(900 + i, 100) for i in range(12)}
    table = [(None, texts[i]) for i in range(6)]                                 # different texts without an id
    table += [(None, texts[0]), (None, near_of(901, 100, 3)), (4, texts[2])]     # a copy, a near copy, a copy with an id
    table += [(7, texts[6]), (7, texts[7]), (8, texts[7]), (7, texts[8])]        # three unlinked texts under one id
    table += [(9, texts[9]), (9, near_of(909, 100, 50)), (9, texts[9])]          # two linked texts under one id
    table += [(5, ""), (5, ""), (None, None), (None, None), (None, " ")]         # no words: all stay
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df.repartition(3), "unused").collect()), key=repr)
    assert got == sorted(survivors_by_hand(table), key=repr)


def survivors_by_hand(table):
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) if (t or "").strip() else set() for _, t in table]
    groups, out = [], []
    for row, s in zip(table, sets, strict=True):
        if not s:
            out.append(row)
            continue
        met = [g for g in groups if any(100 * len(s & x) >= 80 * len(s | x) for _, x in g)]
        groups = [g for g in groups if g not in met] + [[(row, s), *(m for g in met for m in g)]]
    return out + [min((row for row, _ in g), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for g in groups]


def test_pipeline_run_on_rows_without_and_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    def clean(seed):  # passes every rule of the cascade
        r = random.Random(seed)
        return " ".join(r.choice(("the", "and", "of", "with", "that", f"word{r.randrange(900)}", f"other{r.randrange(900)}")) for _ in range(100)) + "."

    table = [(None, clean(i)) for i in range(5)] + [(None, clean(0)), (3, clean(7)), (3, clean(8)), (4, clean(1))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    at = corpus_pipeline.quality(spark, df, "unused")
    assert at.count() == len(table)
    want = sorted(survivors_by_hand(table), key=repr)
    for _, step in corpus_pipeline.STAGES[1:-1]:
        at = step(spark, at, "unused")
    assert sorted(((r.doc_id, r.text) for r in at.select("doc_id", "text").distinct().collect()), key=repr) == want
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r[0] for r in last.select("doc_id").collect()}, key=repr) == sorted({i for i, _ in want}, key=repr)
    assert last.distinct().count() == len(want)
