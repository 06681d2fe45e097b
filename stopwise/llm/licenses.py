"""License scans: phrases by place, and license notices by an exact containment join."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import NOT_WORD, let, packed, scratch, unpacked, words

# Phrases that are found by their words, wherever they stand.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Notices as their licenses word them. Numbers are not compared.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted, provided that the above copyright notice and this permission notice appear in all"
        " copies",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met: Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "apache",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License"
        " at. Unless required by applicable law or agreed to in writing, software distributed under the License"
        " is distributed on an AS IS basis, without warranties or conditions of any kind, either express or"
        " implied",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or any later version",
    ),
    # One notice for each paragraph, as plain license files separate them by blank lines.
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
        " MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied",
    ),
)
# Share of a notice's words that a block must hold.
CONTAINMENT = 0.9
# Notices of so many distinct words are looked for in paragraphs, others in two lines next to each other.
WRAPPED = 20


def _distinct_words(notice: str) -> list[str]:
    found = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
    return sorted({w for w in found if not w.isdigit()})


def _needed(size: int, containment: float) -> int:
    return math.ceil(containment * size - 1e-9)


def phrase_places(tokens: Column, phrases: dict[str, str]) -> Column:
    """(place, label) of every place where a phrase's words stand one after the other."""

    def label(i: Column) -> Column:
        def here(phrase: str) -> Column:
            same = F.lit(True)
            for k, word in enumerate(phrase.split()):
                same = same & (F.get(tokens, i + k) == word)
            return F.coalesce(same, F.lit(False))

        return F.array(*[F.when(here(p), F.lit(name)) for name, p in phrases.items()])

    found = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 1),
        lambda i: F.transform(
            F.filter(label(i), lambda x: x.isNotNull()), lambda x: F.struct(i.alias("place"), x.alias("label"))
        ),
    )
    return F.flatten(F.filter(found, lambda x: F.size(x) > 0))


def scan(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    containment: float = CONTAINMENT,
    wrapped: int = WRAPPED,
) -> DataFrame:
    """Every row of ``docs``, without its text, with the licenses that its text names or quotes.

    Columns added (or replaced): ``n_words``, ``n_base`` (places of the phrases), ``first_word`` and
    ``last_word`` (smallest and largest start of a place), ``base_labels``, ``labels`` (those of the
    notices too; distinct, sorted, joined by commas) and ``score``: 1 if a phrase is found, else the
    largest share of a notice's words that a block holds, if any reaches ``containment``, else 0.

    Text blocks are every line with the one after it, so that a notice may be wrapped, and for notices
    of at least ``wrapped`` distinct words paragraphs. All
    pairs of a block and a notice at the containment are found: words are ordered by the number of
    documents that hold them; a notice is indexed by its rarest words only, as many as one of which
    any match must hold; the places of the first common word in both orders bound the overlap; what
    is left is counted exactly.

    Null texts are empty, without words or labels; ties in the order are broken by the word; repeated
    rows get equal results; an empty table gives no rows. Texts are read whole. The notices are a
    fixed list, so the index is of fixed size and broadcast.
    """
    sets = [(label, _distinct_words(n)) for label, n in notices]
    needed = [_needed(len(s), containment) for _, s in sets]
    short = [i for i, (_, s) in enumerate(sets) if len(s) < wrapped]
    long = [i for i in range(len(sets)) if i not in short]

    def vocabulary(which) -> Column:
        found = sorted({w for i in which for w in sets[i][1]})
        return F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")

    def least(which) -> int:
        return min((needed[i] for i in which), default=1 << 30)

    rows = packed(docs)
    kept = [c for c in docs.columns if c != text]
    body = F.translate(F.coalesce(F.col(f"given.`{text}`"), F.lit("")), ascii_uppercase, ascii_lowercase)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    may_hold = body.rlike("|".join(p.replace(" ", gap) for p in phrases.values()))

    def counted(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.when(may_hold, phrase_places(tokens, phrases)).alias("places"),
            F.array_intersect(tokens, vocabulary(range(len(sets)))).alias("known"),
        )

    def with_next(held: Column) -> Column:
        nothing = F.array(F.array().cast("array<string>"))
        following = F.concat(F.slice(held, F.lit(2), F.size(held)), nothing)
        return F.zip_with(held, following, lambda x, y: F.array_union(x, y))

    def blocks(known: Column, separator: str, which, joined: bool) -> Column:
        of_kind = F.array_intersect(known, vocabulary(which))
        held = let(
            of_kind,
            lambda v: F.transform(
                F.split(body, separator), lambda part: F.array_intersect(F.split(part, NOT_WORD), v)
            ),
        )
        enough = F.filter(let(held, with_next) if joined else held, lambda x: F.size(x) >= least(which))
        return F.when(F.size(of_kind) >= least(which), enough).otherwise(F.array().cast("array<array<string>>"))

    store = scratch(docs, "licenses")
    found = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        let(
            let(words(body, NOT_WORD), counted),
            lambda c: F.struct(
                c["n_words"].alias("n_words"),
                c["places"].alias("places"),
                c["known"].alias("known"),
                blocks(c["known"], "\n", short, True).alias("lines"),
                blocks(c["known"], r"\n[\x20\x09-\x0D]*\n", long, False).alias("paragraphs"),
            ),
        ).alias("found"),
    )
    found = store.save(found, "documents")

    counts = found.select(F.explode("found.known").alias("word")).groupBy("word").count()
    frequency = dict(map(tuple, counts.collect()))  # at most the notices' words
    order = sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for i, (_, s) in enumerate(sets):
        ordered = sorted(s, key=rank.get)
        index += [(w, i, p) for p, w in enumerate(ordered[: len(s) - needed[i] + 1])]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "word string, notice int, place int")
    notice_rows = spark.createDataFrame(
        [(i, label, s, needed[i], i in long) for i, (label, s) in enumerate(sets)],
        "notice int, label string, words array<string>, needed int, wrapped boolean",
    )

    def exploded(column: str, wrapped_kind: bool) -> DataFrame:
        return found.select("id", F.posexplode(f"found.{column}").alias("block", "held")).withColumn(
            "wrapped", F.lit(wrapped_kind)
        )

    all_blocks = exploded("lines", False).unionByName(exploded("paragraphs", True))
    # An intersection keeps the order of its first argument: rare words first.
    in_order = all_blocks.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), "held"))
    probes = in_order.select("id", "block", "wrapped", "held", F.posexplode("held").alias("at", "word"))
    candidates = (
        probes.join(F.broadcast(prefixes), "word")
        .join(F.broadcast(notice_rows), ["notice", "wrapped"])
        .where(F.size("held") >= F.col("needed"))
        .groupBy("id", "block", "wrapped", "notice")
        .agg(
            F.min(F.struct("place", "at")).alias("first"),
            F.first("held").alias("held"),
            F.first("words").alias("words"),
            F.first("needed").alias("needed"),
            F.first("label").alias("label"),
        )
        .where(F.least(F.size("words") - F.col("first.place"), F.size("held") - F.col("first.at")) >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("held", "words"))
    matches = (
        candidates.where(overlap >= F.col("needed"))
        .groupBy("id")
        .agg(F.collect_set("label").alias("matched"), F.max(overlap / F.size("words")).alias("share"))
    )
    places = F.coalesce(F.col("found.places"), F.array().cast("array<struct<place:int,label:string>>"))
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("matched", F.array().cast("array<string>"))))
    return unpacked(
        found.join(matches, "id", "left"),
        kept,
        n_words=F.col("found.n_words"),
        n_base=F.size(places).cast("long"),
        first_word=F.array_min(F.transform(places, lambda p: p["place"])).cast("long"),
        last_word=F.array_max(F.transform(places, lambda p: p["place"])).cast("long"),
        base_labels=F.array_join(base, ","),
        labels=F.array_join(every, ","),
        score=F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double"),
    )
