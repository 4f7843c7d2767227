"""License scans by an exact set-similarity join (operator 2), in DataFrame functions only.

Texts are cut into overlapping blocks of words, licences are templates. A block meets a template if it holds at least the share
``THRESHOLD`` of the template's distinct words. All distinct template words are ordered by their frequency in the whole corpus,
rarest first, and the join keeps to that order:

* prefix filter: a block that meets a template shares one of the template's first ``size - needed + 1`` words, so only blocks with
  such a word are looked at, through an inverted index of these words;
* length filter: a block with fewer template words than are needed is dropped;
* positional filter: the words that can still match behind the matched one, in template and block, must suffice.

What is left is verified by intersecting the sets. Templates are a bounded parameter (some dozens, of any length: each is looked for in blocks of
twice the least power of two times ``STRIDE`` that holds it, whatever the other templates are), so the index and the words' frequencies are broadcast or become literals; texts are never shuffled. The base phrases are templates too: a phrase
fits a block whole, so every place of it is in a block that the join finds, and an exact comparison of consecutive words follows.

Defined cases: a null text has no words; a text of any length is read whole, in blocks; rows that tie in everything keep their own answers; a doc_id that is null or repeats is a row of its own; an empty table stays empty; columns besides doc_id and text
are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import drop, stage

THRESHOLD = 0.8
BLOCK, STRIDE = 128, 64
#: Phrases that give a base label wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening sentences of public licences, by the method's label.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` also changes other letters, which no template has; only the two letters whose lower case is ASCII need more."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the (bounded) vocabulary occurs in all rows; partial sums are taken where the words are."""
    w = words.select(F.explode(column).alias("_w")).filter(F.col("_w").isin(vocabulary)).groupBy("_w").count()
    return dict.fromkeys(vocabulary, 0) | {r["_w"]: r["count"] for r in w.collect()}


def template_index(templates: list[tuple[str, list[str], bool]], frequency: dict[str, int], threshold: float) -> list[dict]:
    """The templates with their distinct words' ranks in ascending order, what a block needs, and the length of the prefix."""
    rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    out = []
    for k, (label, words, phrase) in enumerate(templates):
        ranks = sorted({rank[w] for w in words})
        need = ceil(threshold * len(ranks) - 1e-9)
        out.append({"id": k, "label": label, "words": words, "phrase": phrase, "ranks": ranks, "need": need, "prefix": len(ranks) - need + 1})
    return out


def template_matches(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): rows has _rid, doc_id, n_words; blocks has one row per block and template that meet: _rid, label, phrase,
    score (share of the template's words) and places (starts of the phrase's words in the document; empty for a template)."""
    spark = docs.sparkSession
    all_ = [(label, _split(p), True) for p, label in phrases.items()] + [(label, _split(t), False) for label, t in templates]
    vocabulary = sorted({w for _, words, _ in all_ for w in words})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)).alias("_words"))
    frequency = word_frequencies(split, "_words", vocabulary)
    index = template_index(all_, frequency, threshold)
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    rare = _rare(index, order)

    has = F.arrays_overlap(F.col("_words"), F.array(*map(F.lit, rare)))
    rows = stage(
        split.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", F.size("_words").cast("long").alias("n_words"), F.when(has, F.col("_words")).alias("_words")),
        "words",
    )
    met = None
    for stride in sorted({stride_of(len(t["words"])) for t in index}):
        some = _met(rows, [t for t in index if stride_of(len(t["words"])) == stride], order, stride)
        met = some if met is None else met.unionByName(some)
    return rows.select("_rid", "doc_id", "n_words"), met


def stride_of(length: int) -> int:
    """How far apart the blocks begin in which a template of so many words is looked for: each is twice as long, so one holds any stretch of the template's length."""
    stride = STRIDE
    while stride < length:
        stride *= 2
    return stride


def _rare(index: list[dict], order: list[str]) -> list[str]:
    return sorted({order[r] for t in index for r in t["ranks"][: t["prefix"]]})


def _met(rows: DataFrame, index: list[dict], order: list[str], stride: int) -> DataFrame:
    """The blocks of one size that meet templates of that size."""
    spark, rare = rows.sparkSession, _rare(index, order)
    # Each block: its words, its place, and the ranks of its template words in ascending order.
    b = (
        rows.filter("_words is not null")
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_words") - 1) / stride)).cast("int"))))
        .withColumn("_slice", F.slice(F.col("_words"), F.col("_b") * stride + 1, F.lit(2 * stride)))
        .select("_rid", "_b", "_slice")
        .filter(F.arrays_overlap("_slice", F.array(*map(F.lit, rare))))
    )
    own = F.array_intersect(F.col("_slice"), F.array(*map(F.lit, order)))
    code = F.create_map(*(x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))))
    b = b.withColumn("_ranks", F.sort_array(F.transform(own, lambda w: F.element_at(code, w))))
    entries = [
        (r, place, t["id"], t["label"], t["phrase"], t["words"], t["ranks"], len(t["ranks"]), t["need"])
        for t in index
        for place, r in enumerate(t["ranks"][: t["prefix"]])
    ]
    inverted = spark.createDataFrame(entries, "_r int, _place int, _id int, label string, phrase boolean, _tw array<string>, _tr array<int>, _n int, _need int")
    probe = b.select("_rid", "_b", "_slice", "_ranks", F.posexplode("_ranks").alias("_at", "_br"))
    met = (
        probe.join(F.broadcast(inverted), F.col("_br") == F.col("_r"))
        .filter(F.size("_ranks") >= F.col("_need"))
        # The first common word stands at _place and _at; behind it at most so many more can match.
        .filter(F.least(F.col("_n") - F.col("_place"), F.size("_ranks") - F.col("_at")) + F.least(F.col("_place"), F.col("_at")) >= F.col("_need"))
        .dropDuplicates(["_rid", "_b", "_id"])
        .withColumn("score", F.size(F.array_intersect("_ranks", "_tr")) / F.col("_n"))
        .filter(F.col("score") * F.col("_n") >= F.col("_need"))
    )
    last = F.size("_slice") - F.size("_tw")
    starts = F.when(F.col("phrase") & (last >= 0), F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("_slice"), i + 1, F.size("_tw")) == F.col("_tw")))
    places = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: (F.col("_b") * stride + i).cast("long"))
    return met.select("_rid", "label", "phrase", "score", places.alias("places"))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    rows, met = template_matches(docs, phrases, TEMPLATES if templates is None else templates)
    met = stage(met, "matches")
    places = met.filter("phrase").select("_rid", "label", F.explode("places").alias("_p")).distinct()
    base = places.groupBy("_rid").agg(
        F.count("*").alias("n_base"), F.min("_p").alias("first_word"), F.max("_p").alias("last_word"), F.collect_set("label").alias("_base")
    )
    verdict = met.filter("not phrase or size(places) > 0").groupBy("_rid").agg(F.collect_set("label").alias("_all"), F.max("score").alias("score"))
    joined = lambda c: F.array_join(F.sort_array(F.coalesce(F.col(c), F.array().cast("array<string>"))), ",")
    return (
        rows.join(verdict, "_rid", "left")
        .join(base, "_rid", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            joined("_base").alias("base_labels"), joined("_all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def op2_query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [(label, quoted(_split(p)), "true") for p, label in PHRASES.items()] + [(label, quoted(_split(t)), "false") for label, t in TEMPLATES]
    values = ", ".join(f"('{label}', {words}, {phrase})" for label, words, phrase in rows)
    return rf"""
WITH t(label, tw, phrase) AS (VALUES {values}),
tt AS (SELECT *, list_distinct(tw) AS ts, ceil({THRESHOLD} * len(list_distinct(tw)) - 1e-9) AS need FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
b AS (SELECT rid, x.b AS b, words[x.b * {STRIDE} + 1:x.b * {STRIDE} + {BLOCK}] AS sl FROM d, LATERAL (SELECT unnest(range(0, (len(words) - 1) // {STRIDE} + 1)) AS b) x WHERE len(words) > 0),
m AS (SELECT rid, b, label, phrase, tw, sl, len(list_intersect(sl, ts)) / len(ts) AS score FROM b JOIN tt ON len(list_intersect(sl, ts)) >= need),
p AS (SELECT *, CASE WHEN phrase THEN list_filter(range(0, len(sl) - len(tw) + 1), lambda i: sl[i + 1:i + len(tw)] = tw) ELSE [] END AS places FROM m),
q AS (SELECT DISTINCT rid, label, b * {STRIDE} + u.i AS place FROM p, LATERAL (SELECT unnest(places) AS i) u),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM q GROUP BY rid),
v AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM p WHERE NOT phrase OR len(places) > 0 GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN v USING (rid) LEFT JOIN base USING (rid)
"""


OP2_SQL = _sql()
