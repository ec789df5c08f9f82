"""Licence scan: blocks of normalised text against licence templates by Dice coefficient.

Blocks are the lines, paragraphs, sentences and clauses of a text, and the whole of it, so
a notice is also found beside other words in its line or broken over lines. A block and a
template are compared by the Dice coefficient of their sets of word bigrams. Two bounds
prune without loss: a block whose number of bigrams is too far from a template's cannot
reach the threshold, and neither can one that has none of the template's anchor words
(``anchors``). Everything is DataFrame expressions on the row; nothing is shuffled.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Where a text is cut: lines, paragraphs, sentences (over line ends too), clauses of a line.
CUTS = ["\n", "\n[ \t\r]*\n", "[.!?][ \t\r\n]+", "[.!?,;:]+[ \t\r\n]+|\n"]

# Public wording of licence notices, (licence, kind, text).
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permissive",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions:"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("BSD", "permissive",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met:"),
    ("ISC", "permissive",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "copyleft",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL", "copyleft", "Licensed under the GNU Lesser General Public License."),
    ("AGPL-3.0", "copyleft", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "permissive",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "permissive", "This work is dedicated to the public domain."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "reserved", "All rights reserved."),
]


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Fewest bigrams of a template of ``size`` that a block at the threshold shares with it."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9)


def anchors(text: str, threshold: float = THRESHOLD) -> set[str]:
    """Words, one of which is in every block that reaches the threshold for this template.

    Long words are taken until the bigrams without any of them are too few.
    """
    left, out = bigrams_of(text), set()
    most = needed(len(left), threshold)
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(left) < most:
            break
        out.add(word)
        left = [b for b in left if word not in b.split(" ")]
    return out


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts)


def _normal(block: Column) -> Column:
    return F.trim(F.regexp_replace(block, "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Add licence, licence_kind, dice, n_blocks and licences to every document.

    licence: that of the best block (highest Dice, then first by name), null if no block
    reaches the threshold; dice: its coefficient, 0.0 if none; n_blocks: different blocks
    that reach it for some template; licences: names of all licences found, sorted,
    joined by commas.

    A null or empty text has no block. A block with fewer than two words has no bigram
    and matches nothing. Blocks with the same words count once, so a notice that is both a
    line and a sentence is one block. Texts of any length are scanned
    whole. Other columns pass through; columns named like an added one are replaced.
    """
    docs = docs.drop("licence", "licence_kind", "dice", "n_blocks", "licences")
    rows = []
    for name, kind, text in templates:
        grams = bigrams_of(text)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(len(grams)).alias("n"),
                             F.array(*map(F.lit, grams)).alias("grams")))
    table = F.array(*rows)
    sizes = [len(bigrams_of(t)) for _, _, t in templates]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = needed(min(sizes), threshold), math.floor(max(sizes) * high + 1e-9)
    words = sorted(set().union(*(anchors(t, threshold) for _, _, t in templates)))
    # An anchor that contains another is covered by it.
    words = [w for w in words if not any(v != w and v in w for v in words)]
    lower = F.lower("text")

    def anchored(block: Column) -> Column:
        return _all([F.contains(block, F.lit(w)) for w in words])

    flagged = anchored(lower)
    cut = F.array_distinct(F.concat(*[F.split(lower, c) for c in CUTS], F.array(lower)))
    blocks = F.array_distinct(F.transform(F.filter(cut, anchored), _normal))
    listed = F.transform(blocks, lambda b: F.split(b, " "))
    # At most one bigram per word after the first; repeated ones only lower the number.
    listed = F.filter(listed, lambda w: F.size(w) - 1 >= least)
    grams = F.filter(F.transform(listed, _bigrams), lambda g: F.size(g).between(least, most))

    def against(g: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(g) >= t["n"] * low - 1e-9) & (F.size(g) <= t["n"] * high + 1e-9))
        return F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"),
            t["name"].alias("name"), t["kind"].alias("kind")))

    found = F.transform(grams, lambda g: F.filter(against(g), lambda m: m["dice"] >= threshold))
    found = F.filter(found, lambda m: F.size(m) > 0)
    empty = F.array().cast("array<array<struct<dice:double,name:string,kind:string>>>")
    best = F.array_sort("_flat", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1)
                        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return (docs.withColumn("_found", F.when(flagged, found).otherwise(empty))
            .withColumn("_flat", F.flatten("_found"))
            .withColumn("_best", F.get(best, F.lit(0)))
            .withColumn("licence", F.col("_best")["name"]).withColumn("licence_kind", F.col("_best")["kind"])
            .withColumn("dice", F.coalesce(F.col("_best")["dice"], F.lit(0.0)))
            .withColumn("n_blocks", F.size("_found").cast("long"))
            .withColumn("licences", F.array_join(F.array_sort(F.array_distinct(
                F.transform("_flat", lambda m: m["name"]))), ","))
            .drop("_found", "_flat", "_best"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    rows = ", ".join("({}, {}, [{}])".format(_quoted(n), _quoted(k), ", ".join(map(_quoted, bigrams_of(t))))
                     for n, k, t in TEMPLATES)
    cuts = ", ".join(f"regexp_split_to_array(text, {_quoted(c)})" for c in CUTS)
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(name, kind, grams)),
blocks AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g'), ' ') AS b FROM (
    SELECT doc_id, unnest(list_concat({cuts}, [text])) AS b FROM documents WHERE text IS NOT NULL)),
listed AS (SELECT doc_id, b, string_split(b, ' ') AS w FROM blocks WHERE contains(b, ' ')),
grams AS (
  SELECT doc_id, b, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM listed),
pairs AS (
  SELECT doc_id, b, name, kind, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON len(g) BETWEEN len(grams) * {low!r}::DOUBLE - 1e-9 AND len(grams) * {high!r}::DOUBLE + 1e-9),
hits AS (SELECT * FROM pairs WHERE dice >= {THRESHOLD}::DOUBLE),
best AS (
  SELECT doc_id, first(name ORDER BY dice DESC, name) AS licence, first(kind ORDER BY dice DESC, name) AS licence_kind,
    max(dice) AS dice, count(DISTINCT b) AS n_blocks,
    string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM hits GROUP BY doc_id)
SELECT doc_id, licence, licence_kind, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(n_blocks, 0) AS n_blocks,
  coalesce(licences, '') AS licences
FROM documents LEFT JOIN best USING (doc_id)
"""
