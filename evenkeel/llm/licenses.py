"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block is a line of a document with the lines after it up to a number of words (`reach`) that a template of the
block's class cannot exceed, as a set of words; so that a notice is whole in the block of the line where it starts,
however it is wrapped.  A block matches a template if it holds at least TENTHS tenths of the template's words.  Words are
ordered by how many blocks have them, rarest first; a block that reaches the threshold must share a word of the
template's prefix with a prefix of its own, be long enough, and have enough words left after the first shared one.  The
few pairs that pass are verified in full.  A document as a whole is a bound for all of its blocks: blocks are made only
where it holds enough words of a template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.special import let
from evenkeel.llm.common import Scratch, col
from evenkeel.operators.windows import few

#: Share of a template's words that a block must hold, in tenths.
TENTHS = 8

# Phrases with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices, as their licenses word them.
TEMPLATES = (
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("notice:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("notice:cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("notice:gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("notice:mit", "Released under the MIT License"),
    ("notice:mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("notice:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("notice:isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("notice:mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("notice:reserved", "All rights reserved"),
)

_SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"  # all but the line feed


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words, how many of them a block must hold, reach: the words in all up to a power of two)."""
    out = []
    for label, text in templates:
        every = re.findall(r"[a-z0-9]+", text.lower())
        words = sorted(set(every))
        out.append((label, words, -(-TENTHS * len(words) // 10), max(4, 1 << (len(every) - 1).bit_length())))
    return out


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    lines = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({columns})")


def _prepared(docs: DataFrame, id_col: str, text_col: str, sets: list[tuple[str, list[str], int, int]]) -> DataFrame:
    """For each document: n_words, the phrases' places, and the blocks' template words, where there are enough."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # Two characters have a lower case that holds an ASCII letter; they stay words of their own.
    low = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, words, _, _ in sets for w in words})])
    reaches = {r: [(words, need) for _, words, need, reach in sets if reach == r] for r in sorted({s[3] for s in sets})}
    least = min(need for _, _, need, _ in sets)

    def line(x: Column) -> Column:
        words = F.when(F.trim(x) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(x), " "))
        return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_intersect(w, vocabulary).alias("held")))

    either = "|".join(p.replace(" ", "[ \n]+") for p, _ in PHRASES)

    def places(norm: Column) -> Column:
        """An array with a struct for each phrase found: how often, words before the first and after the last."""
        flat = F.regexp_replace(F.concat(F.lit(" "), norm, F.lit(" ")), "[ \n]+", " ")

        def spaces(x: Column) -> Column:
            return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")

        def place(phrase: str, label: str):
            parts = phrase.count(" ") + 1
            return lambda p: F.struct(F.lit(label).alias("label"), (F.size(p) - 1).cast("long").alias("n"), spaces(F.get(p, F.lit(0))).alias("before"), (spaces(F.element_at(p, -1)) - 1 + parts).alias("after"))

        def each(f: Column) -> Column:
            found = [let(F.split(f, f" {phrase}(?= )", -1), place(phrase, label)) for phrase, label in PHRASES]
            return F.filter(F.array(*found), lambda x: x["n"] > 0)

        return let(flat, each)

    empty = F.array().cast("array<struct<label:string,n:bigint,before:bigint,after:bigint>>")

    none = F.array().cast("array<struct<reach:int,words:array<string>>>")

    def runs(ls: Column, reach: int) -> Column:
        """For each line with words: the template words in it and in the lines after it, until these have reach - 1."""

        def run(x: Column, i: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("held"))
            more = lambda s, y: F.when(s["n"] < reach - 1, F.struct((s["n"] + y["n"]).alias("n"), F.concat(s["held"], y["held"]).alias("held"))).otherwise(s)
            rest = F.aggregate(F.slice(ls, i + 2, F.lit(reach)), start, more, lambda s: s["held"])
            return F.struct(F.lit(reach).alias("reach"), F.array_distinct(F.concat(x["held"], rest)).alias("words"))

        fewest = min(need for _, need in reaches[reach])
        return F.filter(F.transform(ls, run), lambda b: F.size(b["words"]) >= fewest)

    def blocks(ls: Column) -> Column:
        """Blocks of the classes of which the whole document holds enough."""
        held = F.array_distinct(F.flatten(F.transform(ls, lambda x: x["held"])))

        def of(h: Column) -> Column:
            made = []
            for reach, templates in reaches.items():
                can = F.lit(False)
                for words, need in templates:
                    can = can | (F.size(F.array_intersect(h, F.array(*map(F.lit, words)))) >= need)
                made.append(F.when(can, runs(ls, reach)).otherwise(none))
            return F.when(F.size(h) >= least, F.array_distinct(F.concat(*made))).otherwise(none)

        return let(held, of)

    def whole(norm: Column) -> Column:
        lines = F.filter(F.transform(F.split(norm, "\n"), line), lambda x: x["n"] > 0)
        counted = let(lines, lambda ls: F.struct(F.aggregate(ls, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_words"), blocks(ls).alias("blocks")))
        hits = F.when(norm.rlike(either), places(norm)).otherwise(empty)
        return F.struct(counted.alias("c"), hits.alias("hits"))

    made = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("key"), let(F.regexp_replace(low, _SEPARATORS, " "), whole).alias("m"))
    return made.select("id", "key", F.col("m.c.n_words").alias("n_words"), F.col("m.hits").alias("hits"), F.col("m.c.blocks").alias("blocks"))


def _joined(spark: SparkSession, sets: list[tuple[str, list[str], int, int]], blocks: DataFrame) -> DataFrame:
    """(block, label, share) for every distinct block and template of its class with enough in common.

    blocks: (block: a number for the set, reach, words).  What is collected is one count for each of the templates' words.
    """
    counts = dict(map(tuple, blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect()))  # the templates' words only
    order = sorted({w for _, words, _, _ in sets for w in words}, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes, every = [], []
    for t, (label, words, need, reach) in enumerate(sets):
        ranks = sorted(place[w] for w in words)
        prefixes += [(t, reach, r, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        every.append((t, label, "array(" + ",".join(map(str, ranks)) + ")"))
    least = min(need for _, _, need, _ in sets)
    ranked = F.create_map(*[F.lit(x) for w, i in place.items() for x in (w, i)])
    sorted_blocks = blocks.select("block", "reach", F.array_sort(F.transform("words", lambda w: F.try_element_at(ranked, w))).alias("ranks"))
    # A template needs `least` words or more, so that a block's words beyond its own prefix can be left out.
    own = sorted_blocks.select("block", "reach", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - least + 1)).alias("j", "rank"))
    pre = F.broadcast(_values(spark, prefixes, "template, reach, rank, i, size, need"))
    pairs = own.join(pre, ["reach", "rank"]).where((F.size("ranks") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("need")))
    pairs = pairs.groupBy("block", "template").agg(F.first("ranks").alias("ranks"), F.first("size").alias("size"), F.first("need").alias("need"))
    lines = " UNION ALL ".join(f"SELECT {t} AS template, '{label}' AS label, {ranks} AS t_ranks" for t, label, ranks in every)
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    return pairs.join(F.broadcast(spark.sql(lines)), "template").where(shared >= F.col("need")).select("block", "label", (shared / F.col("size")).alias("share"))


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, hits (array of phrases: label, n, before, after), labels (of templates, sorted), score.

    n: the phrase's places; before: words before its first; after: words from the start of its last place to the end.
    score: the largest share of a template's words found in a block that reaches the threshold, 0 without one.
    Null and empty texts have no words.  Repeated rows and null ids stay; an empty table gives no rows.  Other columns
    are not read.  Equal texts, and equal blocks, are matched once; what is joined back to them is sent to all workers as
    long as it is small, so that a hot one is no more work than another.
    """
    sets = template_sets(templates)
    scratch = Scratch(spark, "licenses")
    made = scratch.keep(_prepared(docs, id_col, text_col, sets), "prepared")
    held = made.where("size(blocks) > 0").groupBy("key").agg(F.first("blocks").alias("blocks")).select("key", F.explode("blocks").alias("b"))
    held = scratch.keep(held.select("key", "b.reach", F.array_sort("b.words").alias("words")).withColumn("block", F.xxhash64("reach", "words")), "held")
    blocks = scratch.keep(held.groupBy("block").agg(F.first("reach").alias("reach"), F.first("words").alias("words")), "blocks")
    found = few(_joined(spark, sets, blocks), "license-blocks")
    per_text = few(held.select("key", "block").join(found, "block").groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score")), "license-texts")
    scratch.drop("held", "blocks")  # read for the last time
    out = made.join(per_text, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_words", "hits", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
