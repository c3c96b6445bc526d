"""Licence scan: texts and their lines against licence templates by Dice coefficient.

Text is lower-cased and every run of other characters than letters and digits becomes a
blank. Compared are sets of word bigrams, ``2 * common / (a + b)``. As the common part is
at most the smaller set, a template of ``b`` bigrams can only reach a threshold ``t`` with
texts of ``b * t / (2 - t)`` to ``b * (2 - t) / t`` bigrams: other templates are skipped,
and lines outside the bounds of all templates are never split into bigrams at all.

Templates are a short constant table in the plan; there is no join and no shuffle.

Defined results: null and empty texts match nothing; a line of one word has no bigrams and
matches nothing; a line that repeats is reported each time; a line that matches several
templates gives a row for each, also if they are equally alike; an empty table gives no rows.
A notice spread over several lines is found only if it is the whole text. Row ``line`` 0 is the whole text, if it has several lines.
Columns with the names of results or work columns (``_norm``, ``_u``, ``_body``) are replaced
or dropped.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.columns import let

#: Short public notices, in their usual words.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}
THRESHOLD = 0.9


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: Column) -> Column:
    """Lower case, blanks for all but letters, digits and line ends."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def scan_licenses(
    docs: DataFrame, text: str = "text", *, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` columns but the text, and a row per match: ``line``, ``license``, ``dice``, ``n_bigrams``."""
    grams = {k: template_bigrams(v) for k, v in templates.items()}
    low = lambda n: n * threshold / (2 - threshold)
    high = lambda n: n * (2 - threshold) / threshold
    least, most = min(low(len(g)) for g in grams.values()), max(high(len(g)) for g in grams.values())
    table = F.array(
        *(
            F.struct(F.lit(k).alias("id"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"))
            for k, g in grams.items()
        )
    )
    keep = [c for c in docs.columns if c not in (text, "line", "license", "dice", "n_bigrams", "_norm", "_u", "_body")]
    whole = F.translate("_norm", "\n", " ")
    units = F.concat(
        F.when(F.instr("_norm", "\n") > 0, F.array(F.struct(F.lit(0).alias("line"), whole.alias("body")))).otherwise(
            F.array().cast("array<struct<line:int,body:string>>")
        ),
        F.transform(F.split("_norm", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("body"))),
    )
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    # n bigrams need n + 1 words; repeated ones make a text longer, so this bound is from below only.
    long_enough = lambda u: blanks(F.btrim(u["body"])) >= F.lit(max(1, int(least)))
    lines = (
        docs.where(F.col(text).isNotNull())
        .select(*keep, normalised(F.col(text)).alias("_norm"))
        .select(*keep, F.explode(F.filter(units, long_enough)).alias("_u"))
        .select(*keep, F.col("_u.line").alias("line"), F.col("_u.body").alias("_body"))
    )

    def bigrams(words: Column) -> Column:
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))
        )

    def matches(grams: Column) -> Column:
        n = F.size(grams)
        near = F.filter(table, lambda t: (n >= t["n"] * (threshold / (2 - threshold))) & (n <= t["n"] * ((2 - threshold) / threshold)))
        scored = F.transform(
            near,
            lambda t: F.struct(
                t["id"].alias("license"),
                (F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (n + t["n"])).alias("dice"),
                n.alias("n_bigrams"),
            ),
        )
        return F.when(n.between(int(least), int(most) + 1), F.filter(scored, lambda m: m["dice"] >= threshold))

    found = let(
        F.split(F.btrim("_body"), " +"), lambda w: F.when(F.size(w) >= 2, let(bigrams(w), matches))
    )
    return lines.select(*keep, "line", F.inline(found))
