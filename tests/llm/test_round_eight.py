"""Findings of round four on the training-data operators."""

import numpy as np
import pyarrow as pa

from gradeloom.llm import pair_maxscore


def test_a_file_holds_one_shard(spark, monkeypatch):
    staged = []

    def stage(df, **how):
        staged.append(keep(df, **how))
        return staged[-1]

    keep = pair_maxscore.stage
    monkeypatch.setattr(pair_maxscore, "SHARD_TOKENS", 10)
    monkeypatch.setattr(pair_maxscore, "stage", stage)
    docs = spark.createDataFrame([(i, f"alpha beta w{i} x{i} y{i}") for i in range(40)], "doc_id long, text string").coalesce(2)
    got = pair_maxscore.ranked(docs, spark.createDataFrame([(7, "alpha w3 w5")], "item_id long, text string"), k=3).collect()
    shards = next(s for s in staged if "tfs" in s.columns)
    assert shards.count() == 20 and len(shards.inputFiles()) == 20
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [3, 5, 0]


def test_only_asked_terms_of_a_shard_are_numbered():
    shard = {"terms": pa.array([b"a", b"b", b"c"], pa.binary()), "dfs": np.array([1, 2, 1], np.int32), "docs": np.array([0, 0, 1, 1], np.int32),
             "tfs": np.array([1, 2, 3, 1], np.int32), "doc_ids": np.array([10, 11]), "sizes": np.array([3, 4], np.int32)}
    lists = pair_maxscore.Lists(shard, pa.array([b"b", b"z"], pa.binary()), 2, 7)
    assert lists.number == {b"b": 1}
    docs, own = lists.term(b"b", 5)
    assert docs.tolist() == [0, 1] and own.dtype == np.int64 and lists.term(b"z", 5) is None
