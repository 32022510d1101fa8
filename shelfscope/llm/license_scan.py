"""License scan: an exact set-similarity join of text blocks with license templates, and license phrases.

Templates are short notices. A text is cut into overlapping blocks of words, so that each stretch as long as the longest template lies
in one block. A block matches a template if it holds at least the given share of the template's distinct words (containment).
Words are ordered by how many documents hold them, rarest first; a template's rarest words, just enough that no block can reach the
share without one of them, form its prefix. Blocks and templates meet on prefix words; pairs too short, or whose first common word
leaves too few words behind it, go before the exact comparison. All of it is columns and joins; nothing is read in Python.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.session import stage

#: What separates words: every ASCII character that is neither letter nor digit. Texts are in lower case by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and the labels they give. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and the labels they give.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
CONTAINMENT = 0.8


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each between two spaces of its own (so that repeats never share one); '' for none.

    ``lower`` also changes letters beyond ASCII. Those are word characters before and after, so no word begins or ends elsewhere.
    """
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _count(spaced: Column) -> Column:
    """Words of a spaced text."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrase_columns(spaced: Column) -> list[Column]:
    """n_words, n_base, first_word, last_word and the base labels (array, nulls for absent ones) of a spaced text."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        own = " " + phrase.replace(" ", "  ") + " "
        found = F.contains(spaced, F.lit(own))
        counts.append(F.when(found, (F.length(spaced) - F.length(F.replace(spaced, F.lit(own), F.lit("")))) / len(own)).otherwise(0).cast("long"))
        firsts.append(F.when(found, _count(F.substring_index(spaced, own, 1))))
        lasts.append(F.when(found, _count(spaced) - _count(F.substring_index(spaced, own, -1)) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return [
        _count(spaced).alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"),
    ]


def word_order(words: DataFrame, column: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first by the rows that hold a word; ties by the word. As long as the templates make it."""
    known = F.array(*map(F.lit, vocabulary))
    counts = words.select(F.explode(F.array_intersect(column, known)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    held = {r["w"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (held.get(w, 0), w))


def block_matches(words: DataFrame, order: list[str], templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(row, block, label, share) for each block of ``words`` (row, words array) that reaches the containment of a template."""
    spark = words.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    longest = max(len(t.split()) for t, _ in templates)
    index, whole = [], []
    for number, (text, label) in enumerate(templates):
        ranks = sorted({rank[w] for w in text.split()})
        need = ceil(containment * len(ranks) - 1e-9)
        whole.append((number, label, ranks, need))
        index += [(r, number, at, len(ranks), need) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(index, "rank int, template int, at int, size int, need int")
    notices = spark.createDataFrame(whole, "template int, label string, ranks array<int>, least int")

    rarest = F.array(*(F.lit(order[r]) for r in sorted({x[0] for x in index})))
    ranked = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))
    known = F.array(*map(F.lit, order))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("words") - 1) / longest) - 1, F.lit(0)).cast("int"))
    blocks = (
        words.where(F.arrays_overlap("words", rarest))
        .select("row", "words", F.explode(starts).alias("block"))
        .select("row", "block", F.slice("words", F.col("block") * longest + 1, F.lit(2 * longest)).alias("part"))
        .select("row", "block", F.array_sort(F.transform(F.array_intersect("part", known), lambda w: ranked[w])).alias("have"))
    )
    met = (
        blocks.select("row", "block", "have", F.posexplode("have").alias("place", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where((F.size("have") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("have") - F.col("place")) >= F.col("need")))
        .select("row", "block", "have", "template")
        .distinct()
    )
    shared = F.size(F.array_intersect("have", "ranks"))
    return (
        met.join(F.broadcast(notices), "template")
        .where(shared >= F.col("least"))
        .select("row", "block", "label", (shared / F.size("ranks")).alias("share"))
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    A null text is an empty one and has no labels; a repeated row is scanned again; other columns are not read. ``score`` is the
    largest containment of a template in a block, 1 where a base phrase stands, 0 without either. Only rows that hold a word of some
    template's prefix keep their words, in the shared scratch folder.
    """
    spaced = docs.select(F.col(id_col).alias("doc_id"), spaced_words(F.col(text_col)).alias("spaced"))
    listed = spaced.select("doc_id", "spaced", F.split(F.trim("spaced"), "  ").alias("words"))
    vocabulary = sorted({w for text, _ in templates for w in text.split()})
    order = word_order(listed, "words", vocabulary)
    place = {w: i for i, w in enumerate(order)}
    prefix_words = set()
    for text, _ in templates:
        own = sorted(set(text.split()), key=place.get)
        prefix_words |= set(own[: len(own) - ceil(containment * len(own) - 1e-9) + 1])
    likely = F.arrays_overlap("words", F.array(*map(F.lit, sorted(prefix_words))))
    base = stage(
        listed.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", *phrase_columns(F.col("spaced")), F.when(likely, F.col("words")).alias("words")
        )
    )
    found = (
        block_matches(base.where("words IS NOT NULL").select("row", "words"), order, templates, containment)
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.countDistinct("block").alias("n_blocks"))
    )
    none = F.array().cast("array<string>")
    joined = base.drop("words").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", none)))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_distinct("base_labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
