"""License scans: lines and paragraphs against license templates by Dice over word bigrams."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import index_range, let, lower_ascii, packed

THRESHOLD = 0.8

# Public license notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(templates: Mapping[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(license, sorted distinct bigrams) of each template."""
    out = []
    for name, texts in sorted(templates.items()):
        for w in map(normal_words, texts):
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Sizes of sets that can reach the threshold beside a set of n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def unit_bigrams(unit: Column) -> Column:
    """Distinct bigrams of the normalised words of a unit."""
    plain = F.trim(F.regexp_replace(lower_ascii(unit), "[^a-z0-9]+", " "))
    return let(F.split(plain, " "), lambda w: F.array_distinct(F.transform(index_range(F.size(w) - 1), lambda i: F.concat_ws(" ", w[i], w[i + 1]))))


def license_scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, th, hits: array of (unit, license, dice), best by unit, in order of units.

    Units are the lines of a text and its paragraphs (parts between empty lines) of more than one
    line. Normalised text has A-Z in lower case and everything outside a-z and 0-9 as one space. Dice
    is 2 |A n B| / (|A| + |B|) over sets of word bigrams; a template is compared only where the
    number of the unit's bigrams lies in the bounds from which the threshold can be reached, which
    loses nothing. The templates are constants of the plan, so nothing is joined or shuffled. Units
    of fewer than two words, null and empty texts have no hit; equal Dice values go to the larger
    license name; equal rows get equal results.
    """
    base = packed(docs, ident, text)
    known = template_bigrams(templates)
    low = min((size_bounds(len(g), threshold)[0] for _, g in known), default=0)
    full = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(full, "\n", -1), lambda u: F.struct(F.lit("line").alias("kind"), u.alias("body")))
    blocks = F.filter(F.split(full, r"\n[\x20\t\r]*\n", -1), lambda b: F.contains(F.trim(b), F.lit("\n")))
    blocks = F.transform(blocks, lambda u: F.struct(F.lit("paragraph").alias("kind"), u.alias("body")))

    def best(grams: Column) -> Column:
        found = []
        for name, theirs in known:
            few, many = size_bounds(len(theirs), threshold)
            dice = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in theirs]))) * 2.0 / (F.size(grams) + len(theirs))
            found.append(F.when(F.size(grams).between(few, many), F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
        return F.array_max(F.array(*found))

    def judged(u: Column) -> Column:
        # a unit of fewer characters than its fewest bigrams could have needs no words
        long_enough = F.char_length(u["body"]) >= F.lit(2 * low)
        return F.struct(u["kind"].alias("unit"), F.when(long_enough, let(unit_bigrams(u["body"]), best)).alias("found"))

    hits = F.filter(F.transform(F.concat(lines, blocks), judged), lambda x: x["found"]["dice"] >= threshold)
    hits = F.transform(hits, lambda x: F.struct(x["unit"].alias("unit"), x["found"]["license"].alias("license"), x["found"]["dice"].alias("dice")))
    return base.select("id", "th", hits.alias("hits"))
