"""License scans by diagonal voting. DataFrame functions only.

All rolling ``K``-word hashes of every text meet the template table (a fixed list of a few hundred hashes, broadcast for that reason).
A hit is a text position and a template position; their difference is a diagonal. Votes are counted per text, template and diagonal
(partial sums before the shuffle); neighbouring diagonals, at most ``MAX_SHIFT`` words apart, are merged, so
that a word put in or left out does not split a span. A merged span is verified by a second hash of every hit's words and by the share of the
template's rolling windows it holds: at least ``MIN_COVER`` adds the template's label. ``score`` is the best share of a text, 1 for base
phrases that stand literally.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Base phrases are found at every place.

Null or empty text: no words, no labels, score 0. Null ids, repeated rows: hits are gathered by a key of id and text, equal rows share
it and get equal results. Extra columns are dropped. Ties between templates: every label that is verified is listed. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import documents

K, MAX_SHIFT, MIN_COVER = 3, 3, 0.75
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the base: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices in common use and the label that a verified one gives.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("agpl", "licensed under the gnu affero general public license version"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: What may be added to "attribution", as a short code, in one word, and in words of its own.
CC_ADDED = (("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))
CC_JOINED = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_OLDER = {"nc": "noncommercial", "nd": "noderivs", "sa": "sharealike"}
CC_SPELLED = {"nc": "non commercial", "nd": "no derivatives", "sa": "share alike"}
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")

#: Words that make another license of the same notice.
QUALIFIERS = ("affero", "alike", "commercial", "derivative", "derivatives", "derivs", "lesser", "library", "nc", "nd", "no", "noderivatives", "noderivs", "non",
              "noncommercial", "sa", "share", "sharealike")


def _cc_templates() -> tuple:
    """Short and long forms of the attribution licenses, by rule."""
    plain = [("cc-by", f"creative commons attribution {v}") for v in CC_VERSIONS]
    added = [(f"cc-by-{'-'.join(m)}", form) for m in CC_ADDED for form in dict.fromkeys(
        [f"cc by {' '.join(m)}", *(f"creative commons attribution {' '.join(names[x] for x in m)}" for names in (CC_JOINED, CC_OLDER, CC_SPELLED))])]
    return (*plain, *added)


TEMPLATES += _cc_templates()


def qualifiers(template: str) -> list[str]:
    return sorted(set(template.split()) & set(QUALIFIERS))


def words(text: Column) -> Column:
    """Words of a text; A-Z only are lower-cased (in pure ASCII text ``lower`` does just that)."""
    x = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _grams(ws: Column) -> Column:
    """Hash and second hash of every ``K`` words in a row, in order."""
    def both(i: Column) -> Column:
        gram = [F.get(ws, i + j) for j in range(K)]
        return F.struct(F.xxhash64(*gram).alias("hash"), F.hash(*gram).alias("check"))

    return F.when(F.size(ws) >= K, F.transform(F.sequence(F.lit(0), F.size(ws) - K), both))


def templates(spark) -> DataFrame:
    """template, label, at, hash, check, windows, needs (its qualifiers): the rolling windows of every template."""
    rows = [(n, label, i, *t.split()[i:i + K], len(t.split()) - K + 1, qualifiers(t)) for n, (label, t) in enumerate(TEMPLATES) for i in range(len(t.split()) - K + 1)]
    table = spark.createDataFrame(rows, ", ".join(["template int", "label string", "at int", *(f"w{j} string" for j in range(K)), "windows int", "needs array<string>"]))
    ws = [F.col(f"w{j}") for j in range(K)]
    return table.select("template", "label", "at", "windows", "needs", F.xxhash64(*ws).alias("hash"), F.hash(*ws).alias("check"))


def _places(ws: Column, phrase: str) -> Column:
    """Word positions, from 0, where the phrase stands; texts without it are passed over by a plain search."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    first = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: _all(*(F.get(ws, i + j) == w for j, w in enumerate(parts))))
    return F.when(joined.contains(f" {phrase} "), first).otherwise(F.array().cast("array<int>"))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def spans(keyed: DataFrame) -> DataFrame:
    """key, label, first, last (word positions), cover, needs: template spans of ``keyed`` (key, ws) that hold enough of their template."""
    ws = F.col("ws")
    rolled = keyed.select("key", F.posexplode(_grams(ws)).alias("pos", "gram")).select("key", "pos", "gram.hash", "gram.check")
    hits = rolled.join(F.broadcast(templates(keyed.sparkSession)), ["hash", "check"])
    diagonals = (hits.withColumn("diagonal", F.col("pos") - F.col("at"))
                 .groupBy("key", "template", "label", "windows", "needs", "diagonal")
                 .agg(F.collect_set("at").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")))
    # neighbours: the next diagonal is close by
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT)
    groups = Window.partitionBy("key", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    merged = (diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(groups))
              .groupBy("key", "template", "label", "windows", "needs", "band")
              .agg(F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"), F.min("first").alias("first"),
                   (F.max("last") + (K - 1)).alias("last")))
    cover = F.size("votes") / F.col("windows")
    return merged.withColumn("cover", cover).where(F.col("cover") >= MIN_COVER).select("key", "label", "first", "last", "cover", "needs")


def _marks(ws: Column) -> Column:
    """Places and words of all qualifiers; texts without one are passed over."""
    placed = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda m: m["word"].isin(*QUALIFIERS))
    return F.when(F.arrays_overlap(ws, F.array(*map(F.lit, QUALIFIERS))), placed)


def _verified(found: Column, marks: Column) -> Column:
    """The spans whose qualifiers, up to the word after the span, are those of their template."""
    every = F.coalesce(marks, F.array().cast("array<struct<at:int,word:string>>"))

    def agrees(s: Column) -> Column:
        inside = F.filter(every, lambda m: m["at"].between(s["first"], s["last"] + 1))
        return F.array_sort(F.array_distinct(F.transform(inside, lambda m: m["word"]))) == s["needs"]

    return F.filter(found, agrees)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``."""
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"))
    keyed = docs.select("doc_id", key.alias("key"), words(F.col("text")).alias("ws"))
    found = spans(keyed.select("key", "ws")).groupBy("key").agg(
        F.collect_set(F.struct("label", "cover", "first", "last", "needs")).alias("found"))
    ws = F.col("ws")
    places = [F.transform(_places(ws, p), lambda i: i.cast("long")).alias(f"p{n}") for n, (p, _) in enumerate(PHRASES)]
    based = keyed.select("doc_id", "key", F.size(ws).cast("long").alias("n_words"), _marks(ws).alias("marks"), *places)
    every = F.concat(*(F.col(f"p{n}") for n in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(PHRASES))))
    told = based.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"),
                        F.array_max(every).alias("last_word"), labels.alias("base"), "marks")
    joined = told.join(found, "key", "left").withColumn("found", _verified(F.col("found"), F.col("marks")))
    more = F.coalesce(F.col("found.label"), F.array().cast("array<string>"))
    cover = F.array_max("found.cover")
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                         F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
                         F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(cover, F.lit(0.0))).alias("score"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
v(n, label, t, needs) AS (VALUES {', '.join(f"({n}, '{label}', '{t}', {qualifiers(t)}::VARCHAR[])" for n, (label, t) in enumerate(TEMPLATES))}),
t AS (SELECT n, label, needs, i AS spot, array_to_string(string_split(t, ' ')[i + 1:i + {K}], ' ') AS g, len(string_split(t, ' ')) - {K - 1} AS windows
      FROM v, unnest(range(0, len(string_split(t, ' ')) - {K - 1})) AS u(i)),
h AS (SELECT doc_id, n, label, needs, windows, i, i - spot AS diagonal, spot FROM (SELECT doc_id, i, array_to_string(ws[i + 1:i + {K}], ' ') AS g
        FROM w, unnest(range(0, len(ws) - {K - 1})) AS u(i)) JOIN t USING (g)),
d AS (SELECT DISTINCT doc_id, n, diagonal FROM h),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, n ORDER BY diagonal) AS band FROM (
        SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, n ORDER BY diagonal) <= {MAX_SHIFT} THEN 0 ELSE 1 END AS new FROM d)),
m AS (SELECT doc_id, label, any_value(needs) AS needs, min(i) AS first, max(i) + {K - 1} AS last, count(DISTINCT spot) / any_value(windows) AS cover FROM h JOIN b USING (doc_id, n, diagonal) GROUP BY doc_id, n, label, band),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(cover) AS cover FROM m JOIN w USING (doc_id) WHERE cover >= {MIN_COVER}
        AND list_sort(list_distinct(list_filter(ws[first + 1:last + 2], lambda x: list_contains({list(QUALIFIERS)}, x)))) = needs GROUP BY doc_id),
p AS (SELECT doc_id, len(ws)::BIGINT AS n_words, {', '.join(f"list_filter(range(0, len(ws)), lambda i: array_to_string(ws[i + 1:i + {len(p.split())}], ' ') = '{p}') AS p{n}" for n, (p, _) in enumerate(PHRASES))} FROM w),
q AS (SELECT *, {' || '.join(f'p{n}' for n in range(len(PHRASES)))} AS every,
        list_filter([{', '.join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN f USING (doc_id)
"""
