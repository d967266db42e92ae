"""License scans by diagonal voting, DataFrame functions only.

Every pair of neighbouring words (a rolling k-gram, k = 2) is hashed and joined to the positions of the same pair in the license
templates. A hit votes for its offset diagonal: word position minus template position. Diagonals of one text and template that lie
within ``GAP`` of the next are merged, which lets a few words be added or left out, and a merged span is verified: the pairs it
covers must be ``COVER`` of the template's, in at most ``STRETCH`` times its length. Phrases of the base rule are templates too; a
place of theirs is a diagonal on which all their pairs stand.

Texts are read and cut into words once. Each text has one place more, before its first word, that joins a row of the template table of its
own; so a text without hits, and every text's number of words, come out of the same join.

The templates are a fixed table of a few hundred pairs, so broadcasting them is bounded whatever the documents are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP, COVER, STRETCH = 2, 0.75, 1.6
#: The template number of the place before a text's first word.
OPENING = -1
#: What WORD leaves out, and the capitals: each becomes a space or the small letter.
_CAPITALS = "".join(map(chr, range(0x41, 0x5B)))
_APART = "".join(chr(c) for c in range(0x80) if not re.match("[0-9A-Za-z]", chr(c)))

# The base rule's phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Sentences by which public licenses are declared, and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The words of a text (``WORD`` after A-Z are lower-cased), by one pass over its characters."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _APART + _CAPITALS, " " * len(_APART) + _CAPITALS.lower())
    return F.array_remove(F.split(spaced, " ", -1), "")


def template_pairs(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(tpl, label, is_base, pairs, tpos, t1, t2, pair): the word pairs of all templates, and the row of ``OPENING``."""
    rows = [f"({OPENING}, '', false, 0, 0, '', '', 0L)"]
    for n, (is_base, label, text) in enumerate([(True, label, phrase) for phrase, label in base] + [(False, *x) for x in templates]):
        words = re.findall("[0-9a-z]+", text)
        rows += [f"({n}, '{label}', {str(is_base).lower()}, {len(words) - 1}, {i}, '{a}', '{b}', xxhash64('{a}', '{b}'))" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(tpl, label, is_base, pairs, tpos, t1, t2, pair)")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``score`` is 1 where the base rule holds, else the greatest covered share of an accepted span, else 0. Null and wordless texts have no words and no labels.
    Rows that repeat in key and text have equal results each. Labels that tie in score are all listed. Other columns of ``df``, whatever their names, are not read.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), words_of(F.col(f"`{text}`")).alias("words"))
    places = rows.select("id", "digest", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("i"))
    w1, w2, opening = F.get("words", F.col("i") - 1), F.get("words", F.col("i")), F.col("i") == 0
    pairs = places.select("id", "digest", F.size("words").alias("n_words"), F.col("i"), w1.alias("w1"), w2.alias("w2"), F.when(opening, F.lit(0)).otherwise(F.xxhash64(w1, w2)).alias("own"))
    known = F.broadcast(template_pairs(df.sparkSession, base, templates))
    hits = pairs.join(known, (F.col("own") == F.col("pair")) & (opening & (F.col("tpl") == OPENING) | (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))))
    template = ["id", "digest", "tpl", "label", "is_base", "pairs"]
    wpos = F.col("i") - 1
    diagonals = hits.groupBy(*template, (wpos - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("covered"), F.min(wpos).alias("low"), F.max(wpos).alias("high"), F.max("n_words").alias("n_words"), F.count("*").alias("hits"))
    along = Window.partitionBy("id", "digest", "tpl").orderBy("diagonal")
    is_base, is_text = F.col("is_base"), F.col("tpl") == OPENING
    near = ~is_base & (F.col("diagonal") - F.lag("diagonal").over(along) <= GAP)
    merged = diagonals.withColumn("apart", F.when(near, 0).otherwise(1)).withColumn("cluster", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*template, "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"),
        (F.max("high") + 2 - F.min("low")).alias("length"),
        F.min("diagonal").alias("start"),
        F.max("n_words").alias("n_words"),
        F.max("hits").alias("hits"),
    )
    share = F.when(~is_text, F.col("n") / F.col("pairs"))
    holds = F.when(is_base, F.col("share") == 1).otherwise((F.col("share") >= COVER) & (F.col("length") <= STRETCH * (F.col("pairs") + 1)))
    found = spans.withColumn("share", share).where(is_text | holds)
    result = found.groupBy("id", "digest").agg(
        F.max(F.when(is_text, F.col("hits"))).alias("rows"),
        F.max(F.when(is_text, F.col("n_words"))).cast("long").alias("n_words"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(~is_text, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    # As many rows as the table has of this key and text.
    each = result.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return each.select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
