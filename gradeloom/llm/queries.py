"""Queries of the training-data operators, and the SQL that must agree where SQL can express them."""

from __future__ import annotations

from gradeloom.llm import (ann_forest, chat_perspectives, fst_count, license_scan, mixing, ngram_join, pair_maxscore, pii_crf, piece_bpe, quality_cascade,
                           simple8b, spelling, warc)

QUERIES = {
    "op1_quality_rules": quality_cascade.op1_quality_rules,
    "op2_sentencepiece": piece_bpe.op2_sentencepiece,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_simple8b": simple8b.op5_simple8b,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_chat_perspectives": chat_perspectives.op7_chat_perspectives,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_ann_forest": ann_forest.op9_ann_forest,
    "op10_pii": pii_crf.op10_pii,
    "op11_spelling": spelling.op11_spelling,
    "op12_fst_counts": fst_count.op12_fst_counts,
    "op13_pair_maxscore": pair_maxscore.op13_pair_maxscore,
}

SQL = {
    "op1_quality_rules": quality_cascade.SQL,
    "op3_warc": warc.SQL,
    "op4_mixing": mixing.SQL,
    "op6_ngram_jaccard": ngram_join.SQL,
    "op7_chat_perspectives": chat_perspectives.SQL,
    "op8_license_scan": license_scan.SQL,
    "op11_spelling": spelling.SQL,
    "op13_pair_maxscore": pair_maxscore.SQL,
}
