"""License scans: passages compared to license templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by which works name their license, and short license texts.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def template_bigrams(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(license, distinct word bigrams) for each template, normalised as passages are."""
    found = []
    for name, texts in templates.items():
        for text in texts:
            words = re.sub(r"[\W_]+", " ", text.lower()).split()
            found.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return found


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams of a passage that can reach the threshold with a template of size bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def telling_words(templates: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which each passage that reaches the threshold with some template has at least one.

    Such a passage shares so many of the template's bigrams that those without a telling word don't suffice. The
    longest words that do most are picked first.
    """
    chosen: set[str] = set()

    def lacking() -> list[str]:
        bare = []
        for _, bigrams in templates:
            rest = [b for b in bigrams if not chosen & set(b.split())]
            if len(rest) >= math.ceil(threshold * (bounds(len(bigrams), threshold)[0] + len(bigrams)) / 2 - 1e-9):
                bare += rest
        return bare

    while rest := lacking():
        words = sorted({w for b in rest for w in b.split()})
        chosen.add(max(words, key=lambda w: (min(len(w), 5), sum(w in b.split() for b in rest), w)))
    return sorted(chosen)


def _scored(passage: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The best (dice, license) of a passage's distinct bigrams; templates out of bounds aren't compared."""
    size = F.size(passage)
    each = []
    for name, bigrams in templates:
        low, high = bounds(len(bigrams), threshold)
        dice = 2.0 * F.size(F.array_intersect(passage, F.lit(bigrams))) / (size + len(bigrams))
        each.append(F.when(size.between(low, high), F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
    return F.array_max(F.array(*each))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, licenses (array, sorted), n_passages (long), best_license and best_dice for every row, in one narrow pass.

    A passage is a line, or lines up to an empty one where those are several. Texts without a telling word have no
    match and aren't cut up. In lower case, with all but letters and digits as gaps, its set of
    word bigrams is compared to each template of a fitting size; it matches at a Dice coefficient of threshold or more
    and counts for its best template, of equals the last name. Null and empty texts have no passages; then arrays are empty and
    best_license and best_dice null. Repeated rows and null ids come out as they are; an empty table gives an empty table.
    """
    prepared = template_bigrams(templates)
    ranges = [bounds(len(b), threshold) for _, b in prepared]
    least, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    told = reduce(or_, [lower.contains(w) for w in telling_words(prepared, threshold)])
    rows = docs.select(F.col(id_col).alias("id"), F.when(told, F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " ")).otherwise("").alias("t"))
    blocks = F.filter(F.split("t", r"\n ?\n[ \n]*"), lambda p: F.instr(F.trim(F.translate(p, "\n", "|")), "|") > 0)
    rows = rows.withColumn("passages", F.concat(F.split("t", "\n"), F.transform(blocks, lambda p: F.translate(p, "\n", " "))))
    rows = rows.withColumn("words", F.filter(F.transform("passages", lambda p: F.split(F.trim(F.regexp_replace(p, " +", " ")), " ")), lambda w: F.size(w) > least))
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = rows.withColumn("sets", F.filter(F.transform("words", pairs), lambda b: F.size(b).between(least, most)))
    rows = rows.withColumn("hits", F.filter(F.transform("sets", lambda b: _scored(b, prepared, threshold)), lambda h: h["dice"] >= threshold))
    best = F.array_max("hits")
    return rows.select(
        F.col("id").alias(id_col),
        F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["license"]))).alias("licenses"),
        F.size("hits").cast("long").alias("n_passages"),
        best["license"].alias("best_license"),
        best["dice"].alias("best_dice"),
    )
