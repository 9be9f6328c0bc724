"""License scans: units of text (lines, and paragraphs of several lines) are compared to licence templates by the Dice
coefficient of their sets of word bigrams. DataFrame functions only.

Two bounds prune before any coefficient is taken. Sizes: a Dice of t needs sizes within the factor (2 - t) / t. Prefixes:
of a template with n bigrams, a unit within reach holds one of its first n - ceil(least overlap) + 1; documents without
such a bigram aren't split at all, and units meet templates by an equi-join on these bigrams.

Notices inside longer lines, or wrapped inside longer paragraphs, lie in no such unit: windows of as many bigrams as the
template has are compared as well, at every word of what the fitting lines and paragraphs leave of a text. Licence texts and
file headers are compared by windows only. A window that fits holds a prefix bigram, too, and counts by its first one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient.
THRESHOLD = 0.8
#: Templates up to which their bigrams are sent to every executor; some kB each.
BROADCAST_TEMPLATES = 2_000
#: Notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

GNU_HEADER = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed values: (licence, text) of short licences and of the standard file headers of long ones.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{BSD_START}\n{BSD_END}"),
    ("BSD-3-Clause", f"{BSD_START}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{BSD_END}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", GNU_HEADER.format(colon=";", name="GNU General Public License", version=2)),
    ("GPL-3.0", GNU_HEADER.format(colon=":", name="GNU General Public License", version=3)),
    ("AGPL-3.0", GNU_HEADER.format(colon=":", name="GNU Affero General Public License", version=3)),
    ("LGPL-3.0", GNU_HEADER.format(colon=":", name="GNU Lesser General Public License", version=3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: A word that stands for a line or paragraph that was counted.
COUNTED = "0counted0"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams, in order; a single word is its own bigram."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) or w


def prefix(bigrams: list[str], threshold: float) -> list[str]:
    """What a unit with the threshold's Dice can't miss all of. Dice >= t with sizes a, b means overlap >= t (a + b) / 2,
    and b >= a t / (2 - t), so the overlap is at least a t / (2 - t)."""
    n = len(bigrams)
    least = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    return bigrams[: n - least + 1]


def rare_first(bigrams: list[str]) -> list[str]:
    """The prefix bound holds in any order; long bigrams are rarely met by chance."""
    return sorted(bigrams, key=lambda b: (-len(b), b))


def any_of(bigrams: list[str]) -> str:
    """A pattern that finds any of the bigrams; alternatives share their beginnings, so that most words fail at once."""
    tree: dict = {}
    for b in bigrams:
        at = tree
        for sign in b:
            at = at.setdefault(sign, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:
            return ""
        parts = [("[^a-z0-9]++" if sign == " " else sign) + pattern(x) for sign, x in sorted(at.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?i)(?<![a-z0-9])(?:{pattern(tree)})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value taken once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_order(unit: Column) -> Column:
    """Word bigrams as they come, with repeats."""
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return let(words, lambda w: F.when(F.size(w) <= 1, w).otherwise(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))


def bigrams_of(unit: Column) -> Column:
    """The same as template_bigrams, natively; empty without words."""
    w = F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(w) <= 1, w).otherwise(pairs))


def dice_of(bigrams: Column, template: Column) -> Column:
    return 2 * F.size(F.array_intersect(bigrams, template)) / (F.size(bigrams) + F.size(template))


def windows(docs: DataFrame, table: list[tuple[str, str, bool]], threshold: float) -> DataFrame:
    """(_doc, license, _dice) of each passage of docs (_doc, _text) that a template of table (license, text, whether its
    lines and paragraphs were counted) fits: the best one of the windows that fit and begin within a template's length."""
    spark = docs.sparkSession
    # A text that repeats bigrams is longer than its set of them.
    rules = [(name, b, max(1, len(words_of(t)) - 1), prefix(rare_first(b), threshold), math.ceil(len(b) * threshold / (2 - threshold) - 1e-9), counted) for name, t, counted in table for b in [template_bigrams(t)]]
    anchors = sorted({a for r in rules for a in r[3]})
    rows = docs.filter(F.col("_text").rlike(any_of(anchors)))
    first = F.array_distinct(F.filter(in_order(F.col("_text")), lambda x: x.isin(anchors)))
    met = rows.withColumn("_anchors", first).select("_doc", "_text", "_anchors", F.explode_outer("_anchors").alias("_anchor"))
    side = spark.createDataFrame(rules, "license string, t_bigrams array<string>, t_n int, t_anchors array<string>, t_least int, t_counted boolean")
    side = side.withColumn("t_anchor", F.explode("t_anchors"))
    side = F.broadcast(side) if len(rules) <= BROADCAST_TEMPLATES else side.hint("merge")
    pairs = met.join(side, F.col("_anchor") == F.col("t_anchor")).filter(F.col("_anchor") == F.element_at(F.array_intersect("t_anchors", "_anchors"), 1))
    # Values are bound to lambda variables: a column's expression would be copied into each lambda and taken for each element.
    tb, n, least = F.col("t_bigrams"), F.col("t_n"), F.col("t_least")
    fits = lambda unit: let(F.array_distinct(in_order(unit)), lambda b: dice_of(b, tb) >= threshold)
    line = lambda x: F.when(fits(x), COUNTED).otherwise(x)
    paragraph = lambda p: F.when(F.contains(p, F.lit("\n")) & fits(p), COUNTED).otherwise(F.array_join(F.transform(F.split(p, "\n"), line), " "))
    left = F.when(F.col("t_counted"), F.array_join(F.transform(F.split("_text", r"\n[ \t\r]*\n"), paragraph), " ")).otherwise(F.col("_text"))

    def places(every: Column) -> Column:
        """Places of prefix bigrams (from 0) around which there are words enough for a fit."""
        at = F.filter(F.transform(every, lambda x, i: F.when(F.array_contains("t_anchors", x), i)), lambda i: i.isNotNull())
        return F.filter(at, lambda i: F.size(F.array_intersect(F.slice(every, F.greatest(i - n + 2, F.lit(1)), n * 2 - 1), tb)) >= least)

    def starts(at: Column) -> Column:
        """Each window once: it belongs to the first such place in it."""
        return F.flatten(F.transform(at, lambda i, k: F.sequence(F.greatest(i - n + 1, F.lit(0), F.when(k > 0, F.get(at, k - 1) + 1).otherwise(F.lit(0))), i)))

    def fit(every: Column) -> Column:
        dice = lambda s: let(F.array_distinct(F.slice(every, s + 1, n)), lambda b: dice_of(b, tb))
        return F.filter(F.transform(let(places(every), starts), lambda s: F.struct(s.alias("s"), dice(s).alias("d"))), lambda x: x["d"] >= threshold)

    def passage(done: Column, x: Column) -> Column:
        """A passage takes the fits that begin less than a template's length after its own begin."""
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["s"].alias("s"), F.greatest(last["d"], x["d"]).alias("d"))
        return F.when((F.size(done) > 0) & (x["s"] < last["s"] + n), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    found = F.aggregate(let(in_order(left), fit), F.array().cast("array<struct<s:int,d:double>>"), passage)
    # The outer form, as the optimiser adds a filter to the other one that takes the value twice.
    return pairs.select("_doc", "license", F.explode_outer(found).alias("_p")).filter("_p.d IS NOT NULL").select("_doc", "license", F.col("_p.d").alias("_dice"))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", long_texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """key, license, dice (the largest of any unit, rounded to 6 digits) and n_units, for each document and licence found.

    Documents without licence, null and empty texts have no row. Rows that share an id count as one document. A unit that
    two templates fit counts for both. Templates without words are left out. Units are lines, paragraphs of several lines, and
    passages outside of fitting ones."""
    spark = docs.sparkSession
    table = [(name, b, len(b), p) for name, t in sorted(templates.items()) if (b := rare_first(template_bigrams(t))) for p in prefix(b, threshold)]
    every = [(name, t, True) for name, t in sorted(templates.items()) if words_of(t)] + [(name, t, False) for name, t in long_texts if words_of(t)]
    own = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    gather = lambda scored: scored.groupBy("_doc", "license").agg(F.round(F.max("_dice"), 6).alias("dice"), F.count("*").alias("n_units")).select(F.col("_doc").alias(key), "license", "dice", "n_units")
    if not every:
        return docs.select(key, F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_units")).limit(0)
    if not table:
        return gather(windows(own, every, threshold))
    anchors = sorted({p for *_, p in table})
    ratio = (2 - threshold) / threshold
    small = F.floor(F.lit(min(n for _, _, n, _ in table) / ratio - 1e-9) + 1)
    large = F.floor(F.lit(max(n for _, _, n, _ in table) * ratio + 1e-9))
    anywhere = any_of(anchors)
    near = own.filter(F.col("_text").rlike(anywhere))
    paragraphs = F.filter(F.split("_text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = near.select("_doc", F.explode(F.concat(F.split("_text", "\n"), paragraphs)).alias("_unit"))
    units = units.filter(F.col("_unit").rlike(anywhere)).withColumn("_bigrams", bigrams_of(F.col("_unit"))).withColumn("_n", F.size("_bigrams"))
    units = units.filter(F.col("_n").between(small, large))
    met = units.select("_doc", "_bigrams", "_n", F.explode(F.array_intersect("_bigrams", F.array(*map(F.lit, anchors)))).alias("_anchor"))
    rules = spark.createDataFrame(table, "license string, t_bigrams array<string>, t_n int, t_anchor string")
    side = F.broadcast(rules) if len(templates) <= BROADCAST_TEMPLATES else rules.hint("merge")
    sized = (F.col("_n") <= F.col("t_n") * ratio + 1e-9) & (F.col("t_n") <= F.col("_n") * ratio + 1e-9)
    pairs = met.join(side, (F.col("_anchor") == F.col("t_anchor")) & sized)
    both = F.array_intersect("_bigrams", "t_bigrams")
    # A pair that meets by several anchors counts once: by the first that the unit and the template share.
    once = F.col("_anchor") == F.element_at(F.array_intersect(F.slice("t_bigrams", 1, F.col("t_n") - F.ceil(F.col("t_n") * threshold / (2 - threshold) - 1e-9) + 1), "_bigrams"), 1)
    scored = pairs.filter(once).withColumn("_dice", 2 * F.size(both) / (F.col("_n") + F.col("t_n"))).filter(F.col("_dice") >= threshold)
    return gather(scored.select("_doc", "license", "_dice").union(windows(own, every, threshold)))
