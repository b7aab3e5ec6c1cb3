"""License scans by diagonal voting.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII,
lower-cased in A-Z. Every run of GRAM words of a document is hashed and joined to the
template positions with that hash. A hit at word p of the document and word t of a
template lies on diagonal p - t; a hit counts only if its words equal the template's, not
their hash alone. Hits are summed by diagonal. Neighbouring diagonals at most DRIFT apart
merge into one span (words put in or left out shift the diagonal), unless they hold the
same part of the template, as two notices in a row do. A span is verified against the
template: the template's words that stand in it, in their place on its diagonals, over the
words of the template or of the span, whichever is more, must reach ACCEPT.

The template index holds a few hundred rows made from the constants below, so it is
broadcast; grams whose hash has no bit in a map of it are left out before the join; only hits are shuffled, by document and template, and they are counted on
the map side first. Documents are told apart by id and a 64-bit hash of their text,
so repeated rows share their hits.

The phrases of PHRASES are found wherever their words stand in a row, on top. Null
text is empty; empty and wordless texts get no label and score 0; texts are read whole,
however long; an empty table gives an empty result. Equal scores keep all
labels. A null id is a value like any other. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.runtime import materialize

GRAM, DRIFT, ACCEPT = 3, 6, 0.6
LEAST_HITS = 2
MAP_BITS = 16

#: fixed values: phrase and label
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: fixed values: opening notices of public licenses, by label
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are word characters before lower-casing


def word_array(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z only."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    plain = F.lower(text)
    # lower() agrees with the A-Z rule on plain ASCII text, which it reads faster
    same = F.octet_length(text) == F.length(text)
    words = F.split(F.when(same, plain).otherwise(F.translate(text, upper, lower)), SPLIT)
    return F.filter(words, lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(gram hash, its words, template, label, size, place) of every gram of the templates."""
    rows = [(n, label, len(w), i, w[i : i + GRAM]) for n, (label, text) in enumerate(templates) for w in [_words(text)] for i in range(len(w) - GRAM + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, size int, place int, words array<string>")
    return frame.select(F.xxhash64(*[F.get("words", F.lit(i)) for i in range(GRAM)]).alias("gram"), F.array_join("words", " ").alias("said"), "template", "label", "size", "place")


def known_grams(words: Column, index: DataFrame) -> Column:
    """(p, gram, said) of the grams of a text that may be in the index, by a bit for each hash of it."""
    bits = [0] * (1 << MAP_BITS - 6)
    for (h,) in index.select("gram").distinct().collect():  # built from constants
        bits[(h & (1 << MAP_BITS) - 1) >> 6] |= 1 << (h & 63)
    table = F.lit([x - (1 << 64) if x >> 63 else x for x in bits])

    def may(x: Column) -> Column:
        low = x["gram"].bitwiseAND(F.lit((1 << MAP_BITS) - 1))
        word, bit = F.get(table, F.shiftright(low, 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1

    n = F.size(words) - GRAM
    every = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]).alias("gram")))
    some = F.transform(F.filter(every, may), lambda x: F.struct(x["p"].alias("p"), x["gram"].alias("gram"), F.array_join(F.slice(words, x["p"] + 1, F.lit(GRAM)), " ").alias("said")))
    return F.when(n >= 0, some)


def license_spans(docs: DataFrame, templates=TEMPLATES, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, text_hash, label, first, last, score) of accepted spans of docs(doc_id, text, text_hash); words from 0."""
    index = F.broadcast(template_grams(docs.sparkSession, templates))  # built from constants, below
    words = word_array(F.col("text"))
    found = F.explode(F.get(F.transform(F.array(words), lambda w: known_grams(w, index)), F.lit(0))).alias("x")
    hits = docs.select("doc_id", "text_hash", found).select("doc_id", "text_hash", "x.*").join(index, ["gram", "said"])
    hits = hits.groupBy("doc_id", "text_hash", "template", "label", "size", "p", "place").agg(F.lit(1).alias("one"))
    diagonals = hits.withColumn("d", F.col("p") - F.col("place")).groupBy("doc_id", "text_hash", "template", "label", "size", "d").agg(
        F.collect_set("place").alias("places"), F.min("p").alias("first"), (F.max("p") + GRAM - 1).alias("last"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    own = Window.partitionBy("doc_id", "text_hash", "template").orderBy("d")
    again = (F.col("low") <= F.lag("high").over(own)) & (F.col("high") >= F.lag("low").over(own))
    fresh = F.coalesce((F.col("d") - F.lag("d").over(own) > DRIFT) | again, F.lit(True)).cast("int")
    spans = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(own)).groupBy("doc_id", "text_hash", "template", "label", "size", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda i: F.sequence(i, i + GRAM - 1)))))
    score = covered / F.greatest(F.col("size"), F.col("last") - F.col("first") + 1)
    scored = spans.withColumn("score", score).filter((F.col("score") >= accept) & (F.size("places") >= F.least(F.lit(LEAST_HITS), F.col("size") - GRAM + 1)))
    return scored.select("doc_id", "text_hash", "label", "first", "last", "score")


def phrase_places(words: Column, phrase: str) -> Column:
    own = phrase.split(" ")
    there = lambda i: [F.get(words, i + k) == w for k, w in enumerate(own)]

    def stands(i: Column) -> Column:
        first, *rest = there(i)
        for x in rest:
            first = first & F.coalesce(x, F.lit(False))
        return first

    return F.filter(F.transform(words, lambda w, i: i), stands)


def scan(docs: DataFrame, templates=TEMPLATES, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_words, places per phrase, spans) for each row of docs(doc_id, text)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spans = license_spans(keyed, templates, accept)
    spans = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("label", "first", "last", "score"))).alias("spans"))
    may = F.lower("text").contains("license") | F.lower("text").contains("cc")  # each phrase has one of the two, whatever the case
    none = F.array().cast("array<int>")
    words = F.when(may, word_array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    found = F.get(F.transform(F.array(words), lambda w: F.array(*[phrase_places(w, p) for p, _ in PHRASES])), F.lit(0))
    counted = F.size(F.filter(F.split("text", SPLIT), lambda w: w != "")).cast("long")
    narrow = materialize(keyed.select("doc_id", "text_hash", counted.alias("n_words"), F.when(may, found).otherwise(F.array(*[none] * len(PHRASES))).alias("places")), "phrases")
    joined = narrow.alias("n").join(spans.alias("s"), (F.col("n.text_hash") == F.col("s.text_hash")) & F.col("n.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    return joined.select("n.doc_id", "n_words", "places", F.coalesce("spans", F.array().cast(dict(spans.dtypes)["spans"])).alias("spans"))
