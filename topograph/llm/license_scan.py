"""License notices by diagonal voting, in DataFrame operations only.

All rolling k-grams of words of the documents are hashed and joined to the places of the templates that hold the same
gram; the words are compared after the hashes.  A gram at word p of a document and at word t of a template votes for
the offset diagonal p - t.  Votes are collected by diagonal, and each diagonal takes in those at most `drift` words
off (a word added or left out moves the rest of a notice to the next diagonal); of neighbours, the one on which most
words of the template are found stays.  It is a span of the template's license if these are a share of at least
`min_share` of the template's words.  Of spans of several licenses that begin within `near` words of each other, those
with the greatest share stay, so versions of one license don't stand in for each other.

A phrase is a template that counts where its words stand consecutively, that is where one diagonal holds all its grams.

The templates are the broadcast side: at most TEMPLATE_WORDS words.  Everything else is one shuffle of a row per document
with the votes it holds, of which a group is no longer than its document; all further steps keep that partitioning.
Rows of one identifier and text are the same row and are counted, so no row needs a number of its own and a lost
executor's part can be computed again.

Words are runs of letters, digits and anything outside ASCII, A to Z lower-cased.  Null texts count as empty; texts
without a vote have no spans and score 0; null identifiers are identifiers; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topograph.llm.common import pick

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words of all templates together: bounds what is broadcast.
TEMPLATE_WORDS = 100_000

# Phrases, their labels, and the usual notices of common licenses.
PHRASES: tuple[tuple[str, str], ...] = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(LICENSE_WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """The hash of the k words from each place."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _templates(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """A row for each gram of each template: gram_hash, gram, template, label, phrase, size, t."""
    known = [(label, text, i < len(phrases)) for i, (label, text) in enumerate([*phrases, *notices])]
    if sum(len(text.split()) for _, text, _ in known) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words together")
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(phrase).alias("phrase")) for i, (label, text, phrase) in enumerate(known)])
    split = spark.range(1).select(F.inline(rows)).select("template", "label", "phrase", words_of(F.col("text")).alias("words"))
    placed = split.select("template", "label", "phrase", F.size("words").alias("size"), "words", F.posexplode(_grams(F.col("words"), k)).alias("t", "gram_hash"))
    return placed.select("gram_hash", F.slice("words", F.col("t") + 1, k).alias("gram"), "template", "label", "phrase", "size", "t")


def license_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = 3, drift: int = 4, near: int = 8, min_share: float = 0.8) -> DataFrame:
    """One row per document: identifier, n_words and spans, an array of
    struct<label, first, last (words, from 0), share, template, phrase, place>, by first, last, template;
    phrase: a phrase's words stand consecutively here, from word place on."""
    spark = docs.sparkSession
    whole = pick(docs, id_column, text_column).toDF("id", "text")
    split = whole.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), words_of(F.col("text")).alias("words"))
    # the first element stands for the document itself, so that one without votes has a row
    rolled = split.select("id", "digest", "words", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), _grams(F.col("words"), k))).alias("place", "gram_hash"))
    p = F.col("place") - 1
    hits = (
        rolled.join(F.broadcast(_templates(spark, phrases, notices, k)), "gram_hash", "left")
        .filter((F.col("place") == 0) | (F.col("gram") == F.slice("words", F.col("place"), k)))
        .select("id", "digest", F.size("words").alias("n_words"), F.when(F.col("place") > 0, F.struct("template", "label", "phrase", "size", (p - F.col("t")).alias("diagonal"), "t")).alias("vote"))
    )
    voted = hits.groupBy("id", "digest").agg(F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("vote").isNull()).alias("copies"), F.collect_set("vote").alias("votes"))
    row = ["id", "digest", "n_words", "copies"]
    lines = voted.select(*row, F.explode_outer("votes").alias("v")).select(*row, "v.*")
    lines = lines.groupBy(*row, "template", "label", "phrase", "size", "diagonal").agg(F.collect_set("t").alias("at"))

    around = Window.partitionBy("id", "digest", "template").orderBy("diagonal").rangeBetween(-drift, drift)
    held = F.array_distinct(F.flatten(F.collect_list("at").over(around)))
    found = F.size(F.array_distinct(F.flatten(F.transform(held, lambda t: F.sequence(t, t + (k - 1))))))
    low, high = F.col("diagonal") + F.array_min("at"), F.col("diagonal") + F.array_max("at") + (k - 1)
    merged = lines.select(
        *row, "template", "label", "size", "diagonal", F.size("at").alias("own"), (found / F.col("size")).alias("share"),
        F.min(low).over(around).alias("first"), F.max(high).over(around).alias("last"),
        (F.col("phrase") & (F.size("at") == F.col("size") - (k - 1))).alias("phrase"),
    )
    rank = F.struct("share", "own", -F.col("diagonal"))
    judged = merged.withColumn("verified", (F.col("share") >= min_share) & (rank == F.max(rank).over(around)))
    beside = Window.partitionBy("id", "digest").orderBy("first").rangeBetween(-near, near)
    most = F.max(F.when(F.col("verified"), F.col("share"))).over(beside)
    kept = judged.withColumn("verified", F.col("verified") & (F.col("share") >= most))
    span = F.struct("first", "last", "template", "label", "share", "phrase", F.col("diagonal").alias("place"))
    listed = kept.groupBy(*row).agg(F.array_sort(F.collect_list(F.when(F.col("verified") | F.col("phrase"), span))).alias("spans"))
    return listed.select(F.col("id").alias(id_column), "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """One row per document: identifier, n_words; n_base, first_word, last_word and base_labels of the phrases;
    labels, those of all spans; score, the greatest share of a span (0 without); spans."""
    found = license_spans(docs, id_column, text_column, **options)
    base = F.filter("spans", lambda s: s["phrase"])
    places = F.transform(base, lambda s: s["place"].cast("long"))
    return found.select(
        id_column, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        _joined(F.transform(base, lambda s: s["label"])).alias("base_labels"), _joined(F.transform("spans", lambda s: s["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans",
    )
