"""License scans: exact containment join of text blocks with license templates, in DataFrame functions.

One pass over the texts finds the base phrases and the template words of each document; a
document's text goes on only if some template could reach its threshold from those words. The
words' document counts, over all documents, give the order: rarest first. A block (a line or
sentence) that contains enough of a template must hold one of the template's first words in
that order; length and position bound the rest, and an exact intersection decides. A notice may
run over several lines or sentences, so windows of words are held against the templates too:
a text is cut into stretches of two windows that overlap by one, so that each window lies whole
in a stretch; the same bounds sort out the stretches, and each window of those left is compared.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch
from tallyforge.llm.decontaminate import LOWER, UPPER, let, words

#: The phrases whose places always count, and their labels.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
#: Public notice texts, by the label they give.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "proprietary": "All rights reserved. Unauthorized copying of this file is strictly prohibited",
}
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Where blocks end: line ends, and blanks after a sentence.
BLOCK_END = r"[\n\r]+|(?<=[.!?;])\s+"
#: Words of a window, for each word of the template: room for comment marks and small insertions.
WINDOW = 2


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[str, list[str]], dict[str, int], dict[str, int]]:
    """Distinct words of each template in their own order, how many of them a block needs, and the words of a window."""
    own = spark.createDataFrame(list(templates.items()), "label string, text string").select("label", words(F.col("text")).alias("w")).collect()
    parts = {r.label: list(dict.fromkeys(r.w)) for r in own if r.w}
    return parts, {k: math.ceil(CONTAINMENT * len(w) - 1e-9) for k, w in parts.items()}, {r.label: WINDOW * len(r.w) for r in own if r.w}


def array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def spread(docs: DataFrame, parts: dict[str, list[str]], needs: dict[str, int], phrases: dict[str, str], text_col: str) -> Column:
    """struct(n_words, places array<struct(at, label)>, present, maybe) of a text."""
    listed = {label: text.split(" ") for label, text in phrases.items()}
    vocabulary = sorted({x for w in parts.values() for x in w} | {x for w in listed.values() for x in w})

    def body(w: Column) -> Column:
        def on(p: Column) -> Column:
            places = []
            for label, phrase in listed.items():
                there = F.size(F.array_intersect(p, array(sorted(set(phrase))))) == len(set(phrase))
                starts = F.when(there & (F.size(w) >= len(phrase)), F.sequence(F.lit(0), F.size(w) - len(phrase))).otherwise(F.array().cast("array<int>"))
                places.append(F.transform(_at(w, starts, phrase), _named(label)))
            maybe = F.lit(False)
            for label, w_ in parts.items():
                maybe = maybe | (F.size(F.array_intersect(p, array(w_))) >= needs[label])
            return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*places).alias("places"), p.alias("present"), maybe.alias("maybe"))

        return let(F.array_intersect(w, array(vocabulary)), on)

    return let(words(F.col(text_col)), body)


def _at(w: Column, starts: Column, phrase: list[str]) -> Column:
    def fits(at: Column) -> Column:
        out = F.get(w, at) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(w, at + k) == word)
        return out

    return F.filter(starts, fits)


def _named(label: str):
    return lambda at: F.struct(at.cast("long").alias("at"), F.lit(label).alias("label"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places, labels, score and blocks (block number, label, share) of every row.

    score: 1 where a base phrase stands, else the largest share of a template's words that a
    block or a window holds, 0 if none reaches CONTAINMENT. A window counts under the block in
    which it begins: of a stretch's windows the last of the best. Null texts have no words;
    repeated rows each give a row; null ids stay null; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    parts, needs, widths = template_table(spark, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    scanned = rows.select("id", "key", spread(docs, parts, needs, phrases, "text").alias("s"), "text")
    scanned = _scratch.written(scanned.select("id", "key", "s.n_words", "s.places", "s.present", F.when(F.col("s.maybe"), F.col("text")).alias("text")), "licenses")
    counts = {r.word: r["count"] for r in scanned.select(F.explode("present").alias("word")).groupBy("word").count().collect()}  # a row for each template word
    vocabulary = sorted({x for w in parts.values() for x in w}, key=lambda x: (counts.get(x, 0), x))
    rank = {x: k for k, x in enumerate(vocabulary)}
    by_rank = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    ordered = {k: sorted(rank[x] for x in w) for k, w in parts.items()}
    first = [(r, at, label, len(t), needs[label], widths[label], t) for label, t in ordered.items() for at, r in enumerate(t[: len(t) - needs[label] + 1])]
    prefixes = spark.createDataFrame(first, "rank int, t_at int, label string, t_size int, need int, width int, t array<int>")
    room = F.least(F.col("t_size") - F.col("t_at"), F.size("b") - F.col("b_at"))
    both = F.size(F.array_intersect("b", "t"))

    def near(held: DataFrame, *own: str) -> DataFrame:
        """own and b of held with each template of which b (sorted ranks) holds enough."""
        tokens = held.where(F.size("b") >= min(needs.values(), default=1)).select(*own, "b", F.posexplode("b").alias("b_at", "rank"))
        met = tokens.join(F.broadcast(prefixes), "rank").where((F.size("b") >= F.col("need")) & (room >= F.col("need") - F.least("t_at", "b_at")))
        return met.where(both >= F.col("need"))

    texts = scanned.where("text is not null").dropDuplicates(["key"]).select("key", F.split(F.translate("text", UPPER, LOWER), BLOCK_END).alias("bodies"))
    split = texts.select("key", F.posexplode("bodies").alias("block", "body"))
    held = split.select("key", "block", F.sort_array(F.transform(F.array_intersect(words(F.col("body")), array(vocabulary)), lambda x: F.element_at(by_rank, x))).alias("b"))
    whole = near(held, "key", "block").select("key", "block", "label", (both / F.col("t_size")).alias("share"))

    step = max(widths.values(), default=1)
    run = texts.select("key", F.transform("bodies", lambda x: F.transform(words(x), lambda y: F.coalesce(F.element_at(by_rank, y), F.lit(-1)))).alias("lines"))
    run = run.select("key", F.flatten("lines").alias("r"), F.flatten(F.transform("lines", lambda x, k: F.array_repeat(k, F.size(x)))).alias("of"))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("r") - 1) / step).cast("int"))), lambda k: F.struct(F.slice("r", k * step + 1, 2 * step).alias("r"), F.slice("of", k * step + 1, 2 * step).alias("of")))
    cut = run.where(F.size("r") > 0).select("key", F.posexplode(cuts).alias("part", "c")).select("key", "part", "c.r", "c.of")
    cut = cut.withColumn("b", F.sort_array(F.filter(F.array_distinct("r"), lambda x: x >= 0)))
    wide = near(cut, "key", "part", "r", "of").dropDuplicates(["key", "part", "label"])
    windows = F.transform(F.sequence(F.lit(1), F.size("r")), lambda k: F.struct(F.size(F.array_intersect(F.slice("r", k, F.col("width")), "t")).alias("n"), k.alias("k")))
    best = wide.select("key", "label", "of", "t_size", "need", F.array_max(windows).alias("w")).where(F.col("w.n") >= F.col("need"))
    joined = whole.union(best.select("key", F.element_at("of", F.col("w.k")).alias("block"), "label", (F.col("w.n") / F.col("t_size")).alias("share")))
    joined = joined.groupBy("key", "block", "label").agg(F.max("share").alias("share"))
    blocks = joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "label", "share"))).alias("blocks"))
    out = scanned.drop("text", "present").join(blocks, "key", "left")
    blocks_ = F.coalesce("blocks", F.array().cast("array<struct<block:int,label:string,share:double>>"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base, F.transform(blocks_, lambda x: x["label"])))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks_, lambda x: x["share"])), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "places", base.alias("base_labels"), labels.alias("labels"), score.alias("score"), blocks_.alias("blocks"))
