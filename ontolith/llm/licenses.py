"""Licence scans: TF-IDF cosine to templates, then inheritance down the folders.

A text is read line by line. Each run of one to SPAN lines is a sparse TF-IDF vector of its lower-cased
words, and so is the whole text; their cosines with header templates and with whole licence texts
are taken, and the best one at THRESHOLD or more is the text's licence. Document frequencies of the
template words are counted over all texts; words outside the templates weigh as much as the rarest.
Only runs with a word of a template are vectors, held as (run, term, weight) rows, BLOCK_LINES lines at
a time, so memory follows a block's words, not lines times vocabulary.

A file without a licence of its own takes that of the nearest folder above it that holds a
licence file (LICENSE, LICENCE, COPYING or NOTICE, any ending). Folders are looked at once each,
by an equi-join of their ancestors with the folders that hold licence files.

Defined cases: null and empty texts have no licence of their own; null paths inherit nothing;
of several licence files in a folder the most similar counts, then the name; repeated rows are
judged alike; of templates equally similar the first in the list counts; very long texts are read whole;
an empty table gives an empty result; other columns pass through, whatever their names, but that
license, similarity and line (scan) and origin and licence_folder (inherit) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import cut, numbered

THRESHOLD = 0.7
SPAN = 3
BLOCK_LINES = 1 << 13
#: Of a whole file and a whole licence text.
WHOLE_THRESHOLD = 0.8

# Licence names and usual wordings of their headers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Artistic-2.0", "This package is licensed under the Artistic License 2.0."),
]
TEMPLATES += [(n, f"SPDX-License-Identifier: {n}") for n in ("AGPL-3.0", "Artistic-2.0", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib")]

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
# Whole texts of short licences, compared with whole files.
WHOLE = [
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def _terms(column: pa.Array):
    t = X.flat(column)
    w = X.split(t, X.ALNUM, lower=True)
    return t, w, X.word_hashes(t, w, lower=True)


class Templates:
    """Unit vectors of headers and, after them, of whole licence texts."""

    def __init__(self, templates, whole=()):
        both = [*templates, *whole]
        self.names, self.headers = [n for n, _ in both], len(templates)
        _, w, h = _terms(pa.array([x for _, x in both]))
        self.vocabulary = np.unique(h)
        self.table = X.Table(self.vocabulary)
        self.tf = np.zeros((len(both), len(self.vocabulary)), np.float64)
        np.add.at(self.tf, (w.doc, self.table.find(h)), 1)

    def weigh(self, df: np.ndarray, rows: int):
        self.idf = np.log((rows + 1) / (df + 1)) + 1
        self.rarest = np.log(rows + 1) + 1
        v = self.tf * self.idf
        self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return self


def _frequencies(templates: Templates):
    def run(batches):
        df, rows = np.zeros(len(templates.vocabulary), np.int64), 0
        for b in batches:
            for s, e in X.slices(b.column(0)):
                _, w, h = _terms(b.column(0).slice(s, e - s))
                at = templates.table.find(h)
                pairs = np.unique(w.doc[at >= 0] * len(df) + at[at >= 0])
                df += np.bincount(pairs % len(df), minlength=len(df))
                rows += e - s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df) + 1)), pa.array(np.append(df, rows))], names=["term", "n"])

    return run


def cosines(group: np.ndarray, term: np.ndarray, n: np.ndarray, other: np.ndarray, m: Templates, which: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups (sorted, one row a group and term with its count) and their best template: (group, template, cosine).

    other: by group, the squared weight of words outside the templates.
    """
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    weight = n * m.idf[term]
    dots = np.add.reduceat(weight[:, None] * m.unit[which].T[term], at)
    norm = np.sqrt(np.add.reduceat(weight**2, at) + other[group[at]])
    cos = dots / norm[:, None]
    top = cos.argmax(1)
    return group[at], top + (which.start or 0), cos[np.arange(len(at)), top]


def _summed(group: np.ndarray, term: np.ndarray, n: np.ndarray, k: int):
    """Counts of equal (group, term) rows, sorted."""
    key = group * k + term
    o = np.argsort(key, kind="stable")
    key, n = key[o], n[o]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at] // k, key[at] % k, np.add.reduceat(n, at)


def best(column: pa.Array, m: Templates, threshold: float, span: int, block: int = BLOCK_LINES):
    """Per text: template (-1 for none), similarity, first line of the run (0 for a whole text)."""
    t, w, h = _terms(column)
    lines = X.split(t, np.arange(256) != 0x0A)
    template, sim, at = np.full(len(t), -1), np.zeros(len(t)), np.full(len(t), -1)
    if not len(lines) or not len(h):
        return template, sim, at
    line = np.searchsorted(lines.start, w.start, "right") - 1
    term, k, n = m.table.find(h), len(m.vocabulary), len(lines)
    known = term >= 0
    if not known.any():
        return template, sim, at
    other = np.bincount(line[~known], minlength=n) * m.rarest**2
    row, word, count = _summed(line[known], term[known], np.ones(int(known.sum())), k)
    doc = lines.doc
    number = np.arange(n) - lines.first[doc]
    best_sim, best_t = np.zeros(n), np.full(n, -1)
    for size in range(1, span + 1):
        if size > n:
            break
        beyond = other[: n - size + 1].copy()
        for j in range(1, size):
            beyond += other[j : n - size + 1 + j]
        for begin in range(0, n, block):
            # Runs that begin in this block, as sums of their lines' rows.
            group, terms, counts = [], [], []
            for j in range(size):
                a, z = np.searchsorted(row, [begin + j, begin + block + j])
                start = row[a:z] - j
                ok = (start >= 0) & (start < n - size + 1)
                ok[ok] = doc[start[ok]] == doc[start[ok] + size - 1]
                group.append(start[ok]), terms.append(word[a:z][ok]), counts.append(count[a:z][ok])
            group = np.concatenate(group)
            if not len(group):
                continue
            run, top, value = cosines(*_summed(group, np.concatenate(terms), np.concatenate(counts), k), beyond, m, slice(0, m.headers))
            better = value > best_sim[run] + 1e-12
            best_sim[run[better]], best_t[run[better]] = value[better], top[better]
    ok = np.flatnonzero(best_sim >= threshold)
    order = ok[np.lexsort((number[ok], -best_sim[ok], doc[ok]))]
    first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
    template[doc[first]], sim[doc[first]], at[doc[first]] = best_t[first], best_sim[first], number[first]
    if m.headers < len(m.names):
        outside = np.bincount(w.doc[~known], minlength=len(t)) * m.rarest**2
        text, top, value = cosines(*_summed(w.doc[known], term[known], np.ones(int(known.sum())), k), outside, m, slice(m.headers, len(m.names)))
        better = (value >= WHOLE_THRESHOLD) & (value > sim[text])
        template[text[better]], sim[text[better]], at[text[better]] = top[better], value[better], 0
    return template, sim, at


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, span: int = SPAN, whole=WHOLE) -> DataFrame:
    """files without text, with license, similarity and line (number of the line with content that it starts on)."""
    m = Templates(templates, whole)
    n = len(m.vocabulary)
    counted = files.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(m), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(n + 1, np.int64)
    total[counted["term"].to_numpy(int)] = counted["n"].to_numpy(int)
    m.weigh(total[:n], int(total[n]))
    rest = [c for c in files.columns if c not in ("text", "license", "similarity", "line")]

    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            for s, e in X.slices(text, 1 << 20):
                sub = b.slice(s, e - s)
                t, sim, at = best(sub.column(b.num_columns - 1), m, threshold, span)
                yield pa.RecordBatch.from_arrays(
                    [*sub.columns[:-1], pa.array([m.names[x] if x >= 0 else None for x in t], pa.string()), pa.array(sim), pa.array(at.astype(np.int64))], names=[*rest, "license", "similarity", "line"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*rest).schema)
    return files.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, license string, similarity double, line long")


def inherit(files: DataFrame) -> DataFrame:
    """files (path, license, similarity, ...): adds origin (own, inherited or none) and licence_folder, replacing columns of these names."""
    plain, names = numbered(files.drop("origin", "licence_folder"))
    path, license, similarity = (F.col(names[c]) for c in ("path", "license", "similarity"))
    plain = cut(plain.withColumn("folder", F.regexp_replace(path, "/?[^/]*$", "")))
    name = F.element_at(F.split(path, "/"), -1)
    notices = plain.where(license.isNotNull() & name.rlike("(?i)^(LICEN[SC]E|COPYING|NOTICE)"))
    given = notices.groupBy(F.col("folder").alias("holder")).agg(F.min(F.struct((-similarity).alias("s"), path.alias("path"), license.alias("license"))).alias("best")).select("holder", F.col("best.license").alias("from_holder"))
    folders = plain.where(license.isNull() & path.isNotNull()).select("folder").distinct()
    above = folders.select("folder", F.posexplode(F.expr("transform(sequence(0, size(split(folder, '/'))), i -> concat_ws('/', slice(split(folder, '/'), 1, i)))")).alias("depth", "holder"))
    nearest = above.join(given, "holder").groupBy("folder").agg(F.max(F.struct("depth", "holder", "from_holder")).alias("near"))
    out = plain.join(nearest, "folder", "left")
    own, found = license.isNotNull(), license.isNull() & path.isNotNull() & F.col("near").isNotNull()
    taken = F.when(own, license).when(found, F.col("near.from_holder"))
    return out.select(*((taken if c == "license" else F.col(n)).alias(c) for c, n in names.items()), F.when(own, "own").when(found, "inherited").otherwise("none").alias("origin"), F.when(found, F.col("near.holder")).alias("licence_folder"))
