"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Terms are lower-case runs of letters and digits. Document frequencies cover all terms of all documents. Windows of
one to some lines of any document, and the whole text of a licence file, are vectors over all their terms. A window
can only reach the threshold if it has an *anchor*: the terms left out of the anchors have, in each template, a norm
below the threshold together (Cauchy-Schwarz). Windows start at lines with an anchor, as notices do; texts without one
are passed over without loss.

A file without a licence of its own takes that of the nearest ancestor directory (its own included) that holds a
licence file with one. Directories are resolved once each and joined back by path.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

#: Notices in use, the texts that stand in files, and how the licences' own texts begin.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 Terms and Conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    ),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "LGPL-3.0",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "LGPL-2.1",
        """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA""",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
)
#: Base names of licence files.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: How a notice opens.
NOTICE = "licensed under|released under|this work is licensed under"
#: A window that says that something is not under a licence is no notice of it.
NEGATED = "(not|never|no longer)[ ]+([a-z]+[ ]+)?(licensed|released|distributed|published|available|covered|provided)[ ]+under"
#: Numbers of lines that a window has: next to any length there is one that is at most half as long again.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
#: Up to so many different terms of a corpus, their frequencies are broadcast to the windows' terms.
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def template_terms(templates) -> list[tuple[int, str, list[str]]]:
    return [(k, name, [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]) for k, (name, text) in enumerate(templates)]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of all terms of all documents."""
    seen = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse(df: Column, total: int) -> Column:
    return F.log((1 + F.lit(total)) / (1 + df)) + 1


def template_vectors(split: list[tuple[int, str, list[str]]], idf: dict[str, float]) -> list[tuple[int, str, str, float]]:
    out = []
    for k, name, words in split:
        weight = {t: words.count(t) * idf[t] for t in words}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out += [(k, name, t, w / norm) for t, w in sorted(weight.items())]
    return out


def anchors(vectors: list[tuple[int, str, str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which every vector with a cosine of ``threshold`` to a template has one."""
    kept: set[str] = set()
    for k in {v[0] for v in vectors}:
        own = sorted(((idf[t], t, w) for j, _, t, w in vectors if j == k), reverse=True)
        left = sum(w * w for _, _, w in own)
        for _, t, w in own:
            if math.sqrt(max(left, 0)) < threshold - 1e-9:
                break
            kept.add(t)
            left -= w * w
    return sorted(kept)


def windows(rows: DataFrame, has_anchor, sizes: tuple[int, ...]) -> DataFrame:
    """(doc_id, path, line, size, unit) of the windows over the lines of ``low``: of each size, from each line with an anchor.

    Lines are rows, which meet the next ones of their text in a sliding frame, so that no row holds more than one
    line's windows. A window that holds no more lines than the next smaller size, at the end of a text, is left out.
    """
    whose = ["doc_id", "path", "of"]
    lines = rows.select(*whose, F.posexplode(F.split("low", "\n")).alias("at", "text"))
    ahead = F.collect_list("text").over(Window.partitionBy(*whose).orderBy("at").rowsBetween(0, max(sizes) - 1))
    starts = lines.withColumn("ahead", ahead).where(has_anchor(F.col("text")))
    shapes = F.array(*[F.struct(F.lit(w).alias("size"), F.lit(before).alias("before")) for before, w in zip((0, *sizes), sizes)])
    fitting = F.filter(shapes, lambda s: s["before"] < F.size("ahead"))
    units = starts.select("doc_id", "path", (F.col("at") + 1).alias("line"), "ahead", F.explode(fitting).alias("s"))
    return units.select("doc_id", "path", F.col("line").cast("int").alias("line"), F.col("s.size").alias("size"), F.array_join(F.slice("ahead", 1, F.col("s.size")), "\n").alias("unit"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = 0.7, sizes: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row per input row: doc_id, path, license, score, line, origin, license_file.

    ``files`` has doc_id, path and text. ``score`` is the best cosine of ``threshold`` or more and ``line`` the number,
    from 1, of the first line of the window that has it, or 0 for the whole text of a licence file. Equal scores go to
    the first line, then the fewest lines, then the template that comes first. A window that says that something is
    *not* released (licensed, distributed, ...) under a licence is no notice. ``origin`` is ``file`` (a licence file
    with a licence of its own), ``header`` (any other file with one), ``inherited`` (``license_file`` is the path of the
    source) or ``none``. Of several licence files in one directory the best score counts, then the smallest path. Null
    and empty texts have no licence of their own; a null path inherits nothing. Rows with one doc_id and path
    are one file. An empty table gives no rows; other columns are ignored.
    """
    spark = files.sparkSession
    split = template_terms(templates)
    vocabulary = sorted({t for _, _, words in split for t in words})
    base = files.select("doc_id", "path", "text")
    frequencies = written(document_frequencies(base), "term-frequencies")
    total = base.count()
    seen = {r.term: r.df for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}  # one row per template term
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    vectors = template_vectors(split, idf)
    weights = F.broadcast(spark.createDataFrame(vectors, "template int, license string, term string, weight double"))  # the templates only
    frequencies = F.broadcast(frequencies) if frequencies.count() <= BROADCAST_TERMS else frequencies
    lower = F.lower(F.col("text"))
    marks = anchors(vectors, idf, threshold)
    known = F.array(*[F.lit(t) for t in marks]) if marks else F.array().cast("array<string>")
    has_anchor = lambda text: F.arrays_overlap(terms(text), known)

    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    # Few texts have an anchor at all; the others end here.
    rows = base.select("doc_id", "path", lower.alias("low")).where(has_anchor(F.col("low")))
    rows = rows.groupBy("doc_id", "path", F.xxhash64("low").alias("of")).agg(F.first("low").alias("low"))
    zero = F.lit(0)
    whole = rows.where(F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False)) & F.contains("low", F.lit("\n"))).select("doc_id", "path", zero.alias("line"), zero.alias("size"), F.col("low").alias("unit"))
    units = whole.unionByName(windows(rows, has_anchor, sizes)).where(~F.col("unit").rlike(NEGATED))
    rows_of = ["doc_id", "path", "line", "size"]
    words = units.select(*rows_of, F.explode(terms(F.col("unit"))).alias("term")).groupBy(*rows_of, "term").agg(F.count(F.lit(1)).alias("tf"))
    words = written(words, "licence-terms")
    weighed = words.join(frequencies, "term").withColumn("w", F.col("tf") * inverse(F.col("df"), total))
    # The norm travels as a sum over all the window's words; the products over the templates' terms only.
    pairs = weighed.join(weights, "term")
    norms = weighed.groupBy(*rows_of).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = pairs.groupBy(*rows_of, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rows_of]
    scored = dots.alias("a").join(norms.alias("b"), same).select(*[f"a.{c}" for c in rows_of], "a.template", "a.license", F.round(F.col("a.dot") / F.col("b.norm"), 6).alias("score"))
    best = F.max_by(F.struct("license", "score", "line"), F.struct("score", -F.col("line"), -F.col("size"), -F.col("template"))).alias("own")
    own = written(scored.where(F.col("score") >= threshold).groupBy("doc_id", "path").agg(best), "own-licences").select("doc_id", "path", "own.*")

    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    named = own.where(F.element_at(parts, -1).rlike(FILE_NAME)).withColumn("dir", folder)
    given = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("below"), "path", "license", "score")).alias("from"))
    folders = base.where(F.col("path").isNotNull()).select(folder.alias("dir")).distinct()
    steps = F.split("dir", "/")
    climb = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps)))))
    climb = climb.withColumn("above", F.array_join(F.slice(steps, 1, F.col("depth")), "/")).where((F.col("depth") > 0) | (F.col("above") == ""))
    lent = climb.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("from", "depth").alias("from"))

    out = base.select("doc_id", "path", folder.alias("dir")).alias("f")
    out = out.join(own.alias("o"), F.col("f.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("f.path").eqNullSafe(F.col("o.path")), "left")
    out = out.select("f.*", F.col("o.license").alias("own_license"), F.col("o.score").alias("own_score"), "o.line")
    out = out.join(lent, "dir", "left")
    has, got = F.col("own_license").isNotNull(), F.col("from").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own_license", "from.license").alias("license"),
        F.coalesce("own_score", "from.score").alias("score"),
        F.col("line").cast("int").alias("line"),
        F.when(has & is_file, "file").when(has, "header").when(got, "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from.path")).alias("license_file"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): a tree of source, language and hundreds of ids for a table without paths.

    Of the documents that have a line which opens with a notice, every third id is a licence file, at a level that the
    id decides as well.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    opening = F.contains(low, F.lit("licen")) & low.rlike(rf"(^|\n)({NOTICE})")
    opening = F.coalesce(opening & (F.pmod("doc_id", F.lit(3)) == 0), F.lit(False))
    source, lang, block = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string")
    levels = F.array(source, lang, block)
    name = F.when(opening, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    depth = F.when(opening, F.pmod(F.floor(F.col("doc_id") / 3), F.lit(3)).cast("int") + 1).otherwise(3)
    return docs.select("doc_id", F.array_join(F.concat(F.slice(levels, 1, depth), F.array(name)), "/").alias("path"), "text")
