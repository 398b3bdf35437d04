"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template of t shingles belongs to the level whose windows of W shingles, a step s apart, always hold it whole when it
occurs (t <= W - s + 1). A band is one MinHash value of a window; with all but a share 1 - c of the template present,
window and template have a Jaccard similarity of at least c * t / (W + t * (1 - c)), and `bands` of them miss a match
with the probability (1 - that) ** bands: Plan.miss states it, and the default bands keep it under one in ten thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import LETTERS, mix, slices, windows, words
from ._work import sole, table

# Notices and headers as their licenses word them, by license identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    )),
    ("BSD", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer."
    )),
    ("GPL", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    )),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    )),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ),
    # whole texts
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("BSD-2-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )),
    ("BSD-3-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        'prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND '
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
)


@dataclass(frozen=True)
class Plan:
    """size: words of a shingle; containment: least share of a template's shingles; bands: MinHash values of a window."""

    size: int = 5
    containment: float = 0.8
    bands: int = 28

    @staticmethod
    def level(t: int) -> tuple[int, int]:
        """Window and step, in shingles, for a template of t shingles."""
        w = 1
        while t > w - max(1, w // 4) + 1:
            w *= 2
        return w, max(1, w // 4)

    def miss(self, t: int) -> float:
        w, _ = self.level(t)
        return (1 - self.containment * t / (w + t * (1 - self.containment))) ** self.bands


class Retriever:
    """Templates by level, with their bands in lookup tables."""

    def __init__(self, templates: tuple[tuple[str, str], ...], plan: Plan) -> None:
        self.plan, self.templates = plan, templates
        self.sets = []
        for name, text in templates:
            w = words([text], LETTERS)
            h, _ = windows(w.hash, w.doc, plan.size)
            if not len(h):
                raise ValueError(f"template {name!r} has fewer than {plan.size} words: {text!r}")
            self.sets.append(np.unique(h))
        with np.errstate(over="ignore"):
            seeds = mix(np.arange(1, 2 * plan.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.a, self.b = seeds[: plan.bands] | np.uint64(1), seeds[plan.bands :]
        self.levels: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(self.sets):
            self.levels.setdefault(plan.level(len(s)), []).append(k)
        self.bands = {at: np.array([self._hash(j, self.sets[k]).min() for k in ks for j in range(plan.bands)], dtype=np.uint64).reshape(len(ks), -1) for at, ks in self.levels.items()}

    def _hash(self, j: int, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return x * self.a[j] + self.b[j]

    def find(self, texts: list[str]) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of each verified match; the best place of each pair."""
        w = words(texts, LETTERS)
        h, at = windows(w.hash, w.doc, self.plan.size)
        if not len(h):
            return []
        hits: set[tuple[int, int, int, int]] = set()
        for j in range(self.plan.bands):
            least, width = self._hash(j, h), 1
            for (size, step), ks in sorted(self.levels.items()):
                while width < size:  # windows of twice the width start where those of the width do
                    least = np.minimum(least, np.concatenate([least[width:], np.full(min(width, len(least)), np.iinfo(np.uint64).max, np.uint64)]))
                    width *= 2
                starts = least[::step]
                wanted = self.bands[size, step][:, j]
                table_ = np.zeros(1 << 16, bool)
                table_[(wanted >> np.uint64(48)).astype(np.int64)] = True
                for p in np.flatnonzero(table_[(starts >> np.uint64(48)).astype(np.int64)]):
                    for k, v in zip(ks, wanted, strict=True):
                        if v == starts[p]:
                            hits.add((k, int(p) * step, size, step))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        doc = w.doc[at]
        for k, p, size, _ in sorted(hits):
            own = self.sets[k]
            lo, hi = max(0, p - size), min(len(h), p + 2 * size)
            for d in np.unique(doc[p : p + size]):
                mine = slice(lo + int(np.searchsorted(doc[lo:hi], d)), lo + int(np.searchsorted(doc[lo:hi], d, side="right")))
                inside = np.isin(h[mine], own)
                share = len(np.unique(h[mine][inside])) / len(own)
                if share >= self.plan.containment - 1e-9:
                    first = int(at[mine][np.argmax(inside)])
                    place = (share, -(first - int(np.searchsorted(w.doc, d))))
                    best[int(d), k] = max(best.get((int(d), k), place), place)
        return [(d, k, share, -first) for (d, k), (share, first) in best.items()]


def templates_in(table_: DataFrame, name_col: str = "license", text_col: str = "text", least: int = 5) -> tuple[tuple[str, str], ...]:
    """Templates for license_scan() from a table of license texts, such as a catalogue of all licenses: it comes to the
    driver whole, as it is the caller's and doesn't grow with the corpus. Texts of fewer than `least` words are left out."""
    rows = sole(table_, {"n": name_col, "t": text_col}).where("n is not null and t is not null").distinct().orderBy("n", "t").collect()
    return tuple((r.n, r.t) for r in rows if len(words([r.t], LETTERS).hash) >= least)


def license_scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id",
    text_col: str = "text", plan: Plan = Plan(),
) -> DataFrame:
    """A row per document and license found in it: id, license, containment (of its best template), first_word (its place).

    Words are runs of letters and digits without regard to case. Null, empty and short texts hold no license; rows without
    an id are left out; rows that repeat an id are one document, and the best place of any of them counts. An empty table
    gives no row. Templates need as many words as a shingle has."""
    Retriever(templates, plan)  # refuses bad templates here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Retriever(templates, plan)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for base, texts in slices(batch.column(1)):
                found = scan.find(texts)
                yield pa.record_batch({
                    "id": pa.array([ids[base + d] for d, *_ in found], pa.int64()), "license": pa.array([templates[k][0] for _, k, _, _ in found], pa.string()),
                    "containment": pa.array([s for *_, s, _ in found], pa.float64()), "first_word": pa.array([f for *_, f in found], pa.int64()),
                })

    rows = sole(docs, {"id": id_col, "t": text_col}).where("id is not null").select(F.col("id").cast("long").alias("id"), "t")
    found = rows.mapInArrow(run, "id long, license string, containment double, first_word long")
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("first"))).alias("best")
    return found.groupBy("id", "license").agg(best).select(
        F.col("id").alias(id_col), "license", F.col("best.containment").alias("containment"),
        (-F.col("best.first")).alias("first_word"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
