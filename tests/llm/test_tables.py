"""Training-data operators on pages, vectors and conversations: round trips, brute force, edge rows."""

import hashlib
import random

import numpy as np

from gradeloom.llm import ann_forest, chat_perspectives, warc
from gradeloom.llm.components import components


def test_archives_come_back(spark, tmp_path):
    big = "".join(chr(97 + i % 26) + "é" for i in range(30_000))
    pages = [(1, "http://a/", "<p>short</p>", "x"), (2, "http://b/", "<p>short</p>", "x"), (3, None, None, None), (4, "bad\r\nurl", big, "x"),
             (5, "http://c/", big, "x"), (6, "http://d/", "y" * 999, "x"), (7, "http://e/", "y" * 999, "x"), (8, "http://f/", "z" * 1000, "x"),
             (9, "http://g/", "z" * 1000, "x"), (9, "http://g/", "z" * 1000, "x"), (None, "http://h/", "z" * 1000, "x"), (10, "http://i/", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    warc.write(table, str(tmp_path / "w"), segment_bytes=8000)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    largest = {"z" * 1000: 9, big: 5}
    assert len(got) == len(pages) and all(r.intact for r in got)
    want = []
    for i, _, html, _ in pages:
        data = (html or "").encode()
        to = largest.get(html) if i is not None and largest.get(html) != i else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert next(bytes(r.payload) for r in got if r.page_id == 5) == big.encode()
    warc.write(table.where("false"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_broken_segments_are_told(spark):
    ddl = "kind string, origin string, number int, total long, page_id long, url string, digest string, refers_to long, block binary"
    row = ("response", "o", 1, None, 1, "u", "d", None, bytearray(b"abc"))
    parts = spark.createDataFrame([row, ("continuation", "o", 3, 9, None, None, None, None, bytearray(b"ghi")),
                                   ("continuation", "o", 2, None, None, None, None, None, bytearray(b"def")),
                                   *[(k, "p", n, 9, i, None, None, None, bytearray(b"abc")) for k, n, i in (("response", 1, 2), ("continuation", 3, None))]], ddl)
    got = {r.page_id: r for r in warc.joined(parts).collect()}
    assert got[1].whole and bytes(got[1].block) == b"abcdefghi" and not got[2].whole
    assert warc.unchunked(warc.chunked("héllo")) == ("héllo".encode(), True)
    assert warc.unchunked(b"5\r\nab") == (b"ab", False) and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == (b"abc", True)


def vectors(n, dim=16, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_neighbours_on_edge_rows(spark):
    v = vectors(60).tolist()
    table = [(i, x, 1) for i, x in enumerate(v)] + [(60 + i, v[3], 1) for i in range(14)] + [(100, None, 1), (101, [0.0] * 16, 1), (200, [float("nan")] * 16, 1),
             (102, [None] * 16, 1), (None, v[4], 1), (0, v[0], 1), (300, [1.0, 2.0], 1), (103, [], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann_forest.search(df, df.where("vec_id % 100 = 0 OR vec_id = 3"), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, np.array(x)) for i, x, _ in table[:74]]
    for q in (0, 3):
        want = sorted((float(np.sqrt(((x - np.array(v[q])) ** 2).sum())), i) for i, x in rows if i != q)[:10]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
        assert np.allclose([s for _, _, s in sorted(got[q])], [s for s, _ in want], atol=0, rtol=1e-12)
    assert set(got) == {0, 3}  # 300 has no partner of its length; the others take no part
    assert ann_forest.search(df.where("false"), df.where("false")).count() == 0


def test_recall_of_the_forest(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "SHARD_ROWS", 1500)
    monkeypatch.setattr(ann_forest, "FEWEST", 100)
    v = vectors(6000, 64, 3)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_forest.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 600


def test_perspectives(spark):
    table = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi <|im_end|>", "x"), (1, 2, "bob", "", "x"), (1, 3, "ann", None, "x"), (1, 3, None, "who", "x"),
             (2, 0, "system", "alone", "x"), (None, 5, "eve\n=x", "a", "x"), (None, None, "bob", "b", "x")]
    table += [(7, i, "abc"[i % 3], f"turn {i} " * 40, "x") for i in range(300)] + [(1, 1, "ann", "hi <|im_end|>", "x")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    rotated = chat_perspectives.perspectives(df)
    rows = rotated.collect()
    count = {}
    for r in rows:
        count[r.conv_id, r.assistant] = count.get((r.conv_id, r.assistant), 0) + 1
    assert count == {(1, "ann"): 6, (1, "bob"): 6, (1, "unknown"): 6, (None, "eve x"): 2, (None, "bob"): 2, (7, "a"): 300, (7, "b"): 300, (7, "c"): 300}
    for key in count:
        mine = sorted((r for r in rows if (r.conv_id, r.assistant) == key), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == np.cumsum([0, *(len(r.segment) for r in mine)])[:-1].tolist()
        assert all((r.mask_start is not None) == (r.role == "assistant") for r in mine)
    assert not any("<|im_end|>" in r.segment[:-11] for r in rows)
    texts = chat_perspectives.assembled(rotated).collect()
    assert sum(len(t.text) for t in texts) == sum(len(r.segment) for r in rows) and max(t.part for t in texts) > 0
    ann = next(t for t in texts if (t.conv_id, t.assistant) == (1, "ann"))
    assert [ann.text[m.start:m.end] for m in ann.masks] == ["hi < |im_end| ><|im_end|>"] * 2 + ["<|im_end|>"]
    assert chat_perspectives.perspectives(df.where("false")).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
