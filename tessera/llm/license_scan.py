"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line, a sentence of a line, or a run of adjacent lines: any that a notice wrapped over them could fill,
as the words between its first and last line are no more than the longest template has, with room for edits. A block
meets a template if it contains at least `THRESHOLD` of the template's distinct words. Words are ordered by their frequency over all documents, rarest first. A block that meets a template of t words has one of its
first t - ceil(THRESHOLD * t) + 1 words (prefix filter), at least ceil(THRESHOLD * t) template words (length filter),
and enough words of the order from the first common one on (positional filter). What passes is verified by counting.
All templates that a block meets label it, but for near variants: a template that most of another's words would meet
too gives way to it where the block contains the other better, or as well if the other has all its words and more.
Beside it stand the base phrases: places where their words stand consecutively.

Defined results: a null text counts as empty; a document without words has no places, no labels and score 0; repeated
rows and repeated keys are scanned row by row; templates that a block contains equally well all label it; words of equal
frequency are ordered by name; texts are taken whole, however long; an empty table gives an empty result; other columns
are not read, and their names don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8
#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License notices and their labels (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]


def template_words(text: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER)))) if w]


def lowered(text: Column) -> Column:
    """A-Z lower-cased. `lower` changes other letters too, into others that are no ASCII letters: no ASCII word
    gains or loses a place by it, except with the two capitals below whose lower forms are ASCII."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def places(phrase: str) -> Column:
    """Where the phrase's words stand in `_w`, ascending. Texts without one of its words are not looked through."""
    own = phrase.split(" ")
    there = " AND ".join(f"contains(_t, '{w}')" for w in own)
    same = " AND ".join(f"_w[i + {k}] = '{w}'" for k, w in enumerate(own))
    return F.expr(f"CASE WHEN {there} AND size(_w) >= {len(own)} THEN filter(sequence(0, size(_w) - {len(own)}), i -> {same}) ELSE CAST(array() AS array<int>) END")


def need(size: int, threshold: float) -> int:
    """Words that must be common: the least whole number that is at least threshold * size."""
    return max(1, math.ceil(round(threshold * size, 9)))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Base places and labels of every row. Two passes over the text; only blocks that pass the filters are joined."""
    spark: SparkSession = docs.sparkSession
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    sets = [(label, template_words(t)) for label, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    whole = docs.select(F.col(key).alias("key"), lowered(F.coalesce(F.col(text), F.lit(""))).alias("_t"))

    # Frequencies over all documents; one row per template word at most reaches the driver.
    held = whole.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("_t", NOT_WORD))).alias("w"))
    df = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, prefixes = [], set()
    for t, (label, words) in enumerate(sets):
        own = sorted(words, key=rank.get)
        least = need(len(own), threshold)
        variants = [v for v, (_, other) in enumerate(sets) if v != t and len(set(own) & set(other)) >= least]
        wider = [v for v in variants if set(own) < set(sets[v][1])]
        first = own[: len(own) - least + 1]
        prefixes.update(first)
        index += [(w, t, label, at, len(own), least, own, variants, wider) for at, w in enumerate(first)]

    # A block's template words in global order, for blocks with a prefix word and as many words as the least template
    # needs. Blocks are made only in texts that as a whole meet a template: in others no block does.
    shortest = min(need(len(s), threshold) for _, s in sets)
    between = math.ceil(round(max(len([w for w in re.split(NOT_WORD, t) if w]) for _, t in templates) / threshold, 9))
    some = F.array(*[F.lit(w) for w in order if w in prefixes])
    in_order = lambda words: F.array_intersect(F.array(*map(F.lit, order)), words)
    enough = lambda s: (F.size(s) >= shortest) & F.arrays_overlap(s, some)
    likely = F.lit(False)
    for _, own in sets:
        likely = likely | (F.size(F.array_intersect(F.array(*map(F.lit, own)), F.col("_s"))) >= need(len(own), threshold))
    maybe = F.lit(False)
    for w in sorted(prefixes):
        maybe = maybe | F.contains("_t", F.lit(w))
    lines = F.transform(F.split("_t", "\n"), lambda x: F.struct(F.size(words_of(x)).alias("n"), in_order(F.split(x, NOT_WORD)).alias("s")))
    sentences = F.filter(F.transform(F.split("_t", r"\n|[.;!?]\s"), lambda x: in_order(F.split(x, NOT_WORD))), enough)
    found = [places(p).alias(f"_p{k}") for k, p in enumerate(phrases)]
    rows = whole.select("key", "_t", words_of(F.col("_t")).alias("_w")).select("key", "_t", F.size("_w").cast("long").alias("n_words"), *found, F.when(maybe, in_order(F.col("_w"))).alias("_s"))
    rows = rows.select("*", F.coalesce(likely, F.lit(False)).alias("_likely")).drop("_s")
    rows = rows.select("*", F.when(F.col("_likely"), F.filter(lines, lambda x: x["n"] > 0)).alias("_lines"), F.when(F.col("_likely"), sentences).alias("_sentences")).drop("_t", "_likely")
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "license-blocks")

    # Runs of lines: from each line with template words, on to each such line with few enough words between.
    starts = F.transform("_lines", lambda x, i: F.slice("_lines", i + 1, between + 2))
    run = rows.where(F.size("_lines") > 0).select("_row", F.explode(F.filter(starts, lambda g: F.size(g[0]["s"]) > 0)).alias("g"))
    run = run.select("_row", "g", F.explode(F.sequence(F.lit(1), F.size("g"))).alias("k")).where(F.size(F.col("g")[F.col("k") - 1]["s"]) > 0)
    inner = F.aggregate(F.slice("g", F.lit(2), F.greatest(F.col("k") - 2, F.lit(0))), F.lit(0), lambda n, x: n + x["n"])
    run = run.where(inner <= between).select("_row", in_order(F.flatten(F.transform(F.slice("g", F.lit(1), F.col("k")), lambda x: x["s"]))).alias("b")).where(enough(F.col("b")))
    blocks = run.unionByName(rows.where(F.size("_sentences") > 0).select("_row", F.explode("_sentences").alias("b"))).distinct()

    # The index has one row per prefix word of the given templates, so its size is that of the parameter.
    entries = F.broadcast(spark.createDataFrame(index, "w string, t int, label string, at int, size int, least int, words array<string>, variants array<int>, wider array<int>"))
    probes = blocks.select("_row", "b", F.posexplode("b").alias("in_block", "w")).where(F.array_contains(some, F.col("w")))
    close = probes.join(entries, "w").where(
        (F.size("b") >= F.col("least"))
        & (F.least(F.size("b") - F.col("in_block"), F.col("size") - F.col("at")) + F.least("in_block", "at") >= F.col("least"))
    )
    common = F.size(F.array_intersect("b", "words"))
    pairs = close.where(common >= F.col("least")).select("_row", "b", F.struct("t", "label", (common / F.col("size")).alias("c"), "variants", "wider").alias("p"))
    pairs = pairs.groupBy("_row", "b").agg(F.collect_set("p").alias("_all"))
    beaten = lambda p: F.exists("_all", lambda q: (F.array_contains(p["variants"], q["t"]) & (q["c"] > p["c"])) | (F.array_contains(p["wider"], q["t"]) & (q["c"] >= p["c"])))
    left = pairs.select("_row", F.explode(F.filter("_all", lambda p: ~beaten(p))).alias("p"))
    met = left.groupBy("_row").agg(F.collect_set("p.label").alias("_m"), F.max("p.c").alias("_c"))

    every = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    text_labels = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return rows.join(met, "_row", "left").select(
        F.col("key").alias(key), "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        text_labels(base).alias("base_labels"), text_labels(F.concat(base, F.coalesce("_m", none))).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("_c", F.lit(0.0))).alias("score"),
    )
