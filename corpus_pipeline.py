"""Training-corpus pipeline: quality, near-duplicates, personal data, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared
folder as Parquet and rereads as the next stage's documents. All but the last return the columns of ``documents``. Every stage works
on all rows that its predecessor kept; empty tables pass through as empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import mixing, ngram_join, pii_crf, piece_bpe, quality_cascade
from gradeloom.llm.common import digest_key, documents, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps."""
    return quality_cascade.cascade(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id (nulls last), of these the smallest text.

    Groups are told apart by their key, so null and repeated doc_ids lose nothing. Documents without words meet nothing and all stay.
    """
    row_key = digest_key(*COLUMNS)
    groups = ngram_join.near_duplicates(docs, row_key)
    # equal rows have one key; a group whose smallest doc_id stands on one kind of row needs no look at the texts
    first = stage(groups.where("group_key IS NOT NULL AND doc_id <=> component_id").select("group_key", "row_key").distinct())
    kinds = first.groupBy("group_key").agg(F.count("*").alias("kinds"), F.min("row_key").alias("row_key"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(*COLUMNS).where(worded).withColumn("row_key", row_key).dropDuplicates(["row_key"])
    tied = first.join(kinds.where("kinds > 1").select("group_key"), "group_key")
    least = (keyed.join(tied, "row_key").groupBy("group_key").agg(F.min(F.struct("text", "lang", "source", "n_chars", "row_key")).alias("least"))
             .select("least.row_key"))
    keep = stage(kinds.where("kinds = 1").select("row_key").union(least))
    return keyed.join(keep, "row_key", "left_semi").select(*COLUMNS).union(docs.select(*COLUMNS).where(~worded))


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return pii_crf.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated towards the target entropy."""
    return mixing.mix(docs).select(*COLUMNS)


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and the text they decode to, as digests."""
    return piece_bpe.digests(piece_bpe.encode(docs), "doc_id", "source")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]

#: A conditional random field and a trained tokenizer's merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
