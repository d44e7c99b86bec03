"""Licence scan: windows of a text against licence templates, by Dice coefficient over word bigrams.

Only SQL functions run. Text is normalised (ASCII lower case, every run of other characters than
letters and digits is one space), so line breaks and punctuation don't count. With a and b distinct
bigrams of a window and a template, Dice is 2 * shared / (a + b); it reaches `least` only if a lies
between b * least / (2 - least) and b * (2 - least) / least. These size bounds choose the windows that
a template is compared with: all that start and end with one of its bigrams (a window with another one
at an end resembles it less than without) and hold at most b * (2 - least) / least bigrams, repeats
counted. The bounds also mean that at least b * least / (2 - least) bigrams of the template are shared,
so a document that has none of a few chosen bigrams of any template is passed over at once, and so is
one that has none of these bigrams' longer words; nothing is lost by it. Of the windows that share a
bigram's place the most similar one stands (then the longer, the earlier, the lesser template).

Defined results: null or empty text has no row. A document id that occurs in several rows is one
document, the windows of its rows are pooled. Of equal windows the first, then the shortest counts.
Templates shorter than two words are refused. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wordings with which public licences are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Released into the public domain under CC0 1.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy "
    "of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
    "Apache-2.0-name": "Apache License 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" "
    "AND ANY EXPRESS OR IMPLIED WARRANTIES",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "GPL-2.0-name": "GNU General Public License version 2",
    "GPL-2.0-notice": "under the terms of the GNU General Public License as published by the Free "
    "Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-name": "GNU General Public License version 3",
    "GPL-3.0-notice": "under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-3.0-name": "GNU Lesser General Public License version 3",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    "MPL-2.0-name": "Mozilla Public License 2.0",
}
LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, least: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams of a passage that can reach `least`."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is made once, however often the expression names it: as the
    one element of an array.  Spark copies plain expressions into filters and functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bigrams(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2))
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    least: float = LEAST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document and licence found: doc_id, licence, dice, word (its first,
    from 1), n_words."""
    kinds = {name: template_bigrams(text) for name, text in templates.items()}
    if short := [name for name, found in kinds.items() if not found]:
        raise ValueError(f"templates of fewer than two words: {short}")
    if not 0 < least <= 1 or not kinds:
        raise ValueError("give templates, and a least coefficient above 0 and up to 1")
    # Of each template so many bigrams that a match must have one of them; the longest are rarest.
    needed = {
        g
        for b in kinds.values()
        for g in sorted(b, key=lambda g: (-len(g), g))[: len(b) - bounds(len(b), least)[0] + 1]
    }
    words = sorted({max(g.split(), key=len) for g in needed})

    def any_in(text: Column, parts: list[str]) -> Column:
        """Whether a text has any of these."""

        def test(t: Column) -> Column:
            hit = F.lit(False)
            for part in parts:
                hit = hit | F.contains(t, F.lit(part))
            return hit

        return F.coalesce(_once(text, test), F.lit(False))

    padded = F.concat(F.lit(" "), normalised(F.col("text")), F.lit(" "))
    found = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = found.where(any_in(F.lower("text"), words))
    found = found.where(any_in(padded, [f" {g} " for g in sorted(needed)]))
    words_of = F.split(normalised(F.col("text")), " ")
    found = found.select("doc_id", F.xxhash64("text").alias("th"), words_of.alias("words"))
    found = found.where(F.size("words") > 1)
    every = sorted({g for b in kinds.values() for g in b})

    def hits_in(grams: Column) -> Column:
        """The bigrams of a text, and which of them are in some template, with their places."""
        placed = F.transform(grams, lambda g, i: F.struct((i + 1).alias("i"), g.alias("g")))
        return F.struct(grams.alias("grams"), F.filter(placed, lambda h: h["g"].isin(every)).alias("hits"))

    table = F.array(
        *(
            F.struct(
                F.lit(name).alias("licence"),
                F.array(*map(F.lit, b)).alias("grams"),
                F.lit(bounds(len(b), least)[0]).alias("low"),
                F.lit(bounds(len(b), least)[1]).alias("high"),
            )
            for name, b in kinds.items()
        )
    )

    def windows(t: Column, own: Column, grams: Column) -> Column:
        """Windows from one of the template's bigrams to another one, and their coefficients."""

        def from_hit(h: Column, k: Column) -> Column:
            def upto(after: Column) -> Column:
                def window(e: Column, m: Column) -> Column:
                    n = e["i"] - h["i"] + 1
                    size = F.size(F.array_distinct(F.slice(grams, h["i"], n)))
                    shared = F.size(F.array_distinct(F.transform(F.slice(after, 1, m + 1), lambda x: x["g"])))
                    dice = F.when(size.between(t["low"], t["high"]), 2.0 * shared / (F.size(t["grams"]) + size))
                    return F.struct(
                        (-dice).alias("far"), (-n).alias("less"), h["i"].alias("start"), t["licence"].alias("licence")
                    )

                # Fewer hits than the lower bound can't be alike.
                near = F.transform(after, lambda e, m: F.when(m + 1 >= t["low"], window(e, m)))
                return F.filter(near, lambda w: w["far"] <= -least)

            ahead = F.filter(F.slice(own, k + 1, t["high"]), lambda e: e["i"] < h["i"] + t["high"])
            return _once(ahead, upto)

        return F.flatten(F.transform(own, from_hit))

    def alike(text: Column) -> Column:
        def with_template(t: Column) -> Column:
            own = F.filter(text["hits"], lambda h: F.array_contains(t["grams"], h["g"]))
            return _once(own, lambda o: windows(t, o, text["grams"]))

        return F.flatten(F.transform(table, with_template))

    scored = _once(_once(F.col("words"), _bigrams), lambda grams: _once(hits_in(grams), alike))
    passages = found.select("doc_id", "th", F.explode(scored).alias("p")).distinct()
    # Of the windows that cover a place the best; a window stays if it is that for all its places.
    covered = passages.withColumn(
        "at", F.explode(F.sequence(F.col("p.start"), F.col("p.start") - F.col("p.less") - 1))
    )
    best = covered.groupBy("doc_id", "th", "at").agg(F.min("p").alias("p"))
    whole = best.groupBy("doc_id", "th", "p").agg(F.count("*").alias("places")).where("places = -p.less")
    return (
        whole.groupBy("doc_id", F.col("p.licence").alias("licence"))
        .agg(F.min(F.struct("p.far", "p.start", (-F.col("p.less")).alias("n"))).alias("b"))
        .select(
            "doc_id", "licence", (-F.col("b.far")).alias("dice"),
            F.col("b.start").cast("int").alias("word"), (F.col("b.n") + 1).cast("int").alias("n_words"),
        )
    )


def oracle(templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same scan in DuckDB: every window between two bigrams of every template."""
    values = ", ".join(
        "('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in template_bigrams(text)))
        for name, text in templates.items()
    )
    norm = "trim(regexp_replace(translate(text, '%s', '%s'), '[^a-z0-9]+', ' ', 'g'))" % (UPPER, LOWER)
    return f"""
with templates(licence, own) as (values {values}),
sized as (
  select *, ceil(len(own) * {least} / (2 - {least}) - 1e-9) low,
         floor(len(own) * (2 - {least}) / {least} + 1e-9) high from templates),
cut as (select doc_id, string_split({norm}, ' ') words from documents where text is not null),
texts as (
  select doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) grams
  from cut where len(words) > 1),
placed as (select doc_id, unnest(grams) g, unnest(range(1, len(grams) + 1)) i from texts),
wanted as (select licence, low, high, own, unnest(own) g from sized),
hits as (select doc_id, i, licence, low, high, own from placed join wanted using (g)),
pairs as (
  select a.doc_id, a.licence, a.i start, b.i - a.i + 1 n, a.own, a.low, a.high
  from hits a join hits b on a.doc_id = b.doc_id and a.licence = b.licence and b.i between a.i and a.i + a.high - 1),
spans as (select p.*, list_distinct(t.grams[start:start + n - 1]) grams from pairs p join texts t using (doc_id)),
scored as (
  select doc_id, licence, start, n, 2.0::double * len(list_intersect(own, grams)) / (len(own) + len(grams)) dice
  from spans where len(grams) between low and high),
covered as (
  select *, row_number() over (partition by doc_id, "at" order by dice desc, n desc, start, licence) b
  from (select *, unnest(range(start, start + n)) "at" from scored where dice >= {least}::double)),
whole as (select doc_id, licence, dice, start, n from covered where b = 1 group by all having count(*) = n),
best as (select *, row_number() over (partition by doc_id, licence order by dice desc, start, n) r from whole)
select doc_id, licence, dice, start::int as word, (n + 1)::int as n_words from best where r = 1
"""
