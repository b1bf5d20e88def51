"""License scans by patience alignment of texts with license templates.

Words are runs of letters, digits and +, with dots inside, lower case. A template is found where
at least `coverage` of its words align, in order, with words of a stretch of text. As at most m of
a template's words may be missing, any m + 1 of them hold one that is there: texts without one of the template's longest
m + 1 words are passed over. Around each place of those words, what is before it in the text and in the template is
aligned, and what is after it, up to several distances: the template's own, also with m words more, to the
next place of the same word, and twice the template's length. So words that occur again in a notice nearby hide none. Stretches of
twice the template's length around those words (overlapping ones as one) are aligned as well. Of what aligns, the most words
within twice the template's length count; of hits that overlap, the one with the most words, then the shortest, stays.

Patience alignment of a stretch: equal words at both ends are matched; words that occur once in
the stretch and once in the template are anchors if they lie on the longest increasing subsequence of
places; each gap between anchors is aligned in the same way; a gap without anchors is left unmatched.

Templates are notices and whole licenses; `load_templates` reads more from text files.

Defined results: null and empty texts hold no license; repeated rows give repeated results; a null id stays null; an empty table
gives no rows; a very long text is scanned whole; a template with several places in a text gives a row for each, and so does
a notice that is part of a whole license found there. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import in_small_batches, read, releasing

_WORD = re.compile(r"[^\W_+]+(?:\.[^\W_]+)*\+*")

#: Notices and whole texts of public licenses, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def load_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of text files, each named as its file: a handful of license texts, read through Spark."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1).alias("name"), "value")
    return {r["name"]: r["value"] for r in files.collect()}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    below: list[int] = []
    for k, x in enumerate(places):
        pile = bisect_left(tops, x)
        below.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1], ends[pile : pile + 1] = [x], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[p] == b[r]:
            out.append((p, r))
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1]:
            q, s = q - 1, s - 1
            out.append((q, s))
        if p == q or r == s:
            continue
        left, right = Counter(a[p:q]), Counter(b[r:s])
        at = {w: k for k, w in enumerate(b[r:s], r) if right[w] == 1}
        both = [(k, at[w]) for k, w in enumerate(a[p:q], p) if left[w] == 1 and w in at]
        anchors = [both[k] for k in rising([y for _, y in both])]
        if not anchors:
            continue
        out += anchors
        for (x, y), (u, v) in zip([(p - 1, r - 1), *anchors], [*anchors, (q, s)], strict=True):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def densest(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The most pairs that lie within span words of text; the first of equals."""
    best, i = (0, 0), 0
    for j in range(len(pairs)):
        while pairs[j][0] - pairs[i][0] >= span:
            i += 1
        if j + 1 - i > best[1] - best[0]:
            best = (i, j + 1)
    return pairs[best[0] : best[1]]


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of hits (order, words from first to last, first) the least that don't overlap with lesser ones, by place."""
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(set(hits)):
        at = bisect_left(kept, hit[2], key=lambda h: h[2])
        if (at == 0 or kept[at - 1][2] + kept[at - 1][1] < hit[2]) and (at == len(kept) or hit[2] + hit[1] < kept[at][2]):
            kept.insert(at, hit)
    return kept


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = []
        for name, text in sorted(templates.items()):
            t = words(text)
            missing = len(t) - math.ceil(coverage * len(t) - 1e-9)
            # the longest words, each as often as it occurs, so that missing + 1 of the template's words are meant
            order = sorted(range(len(t)), key=lambda k: (-len(t[k]), k))[: missing + 1]
            self.templates.append((name, t, frozenset(t[k] for k in order), missing))
        self.marks = frozenset().union(*[marks for _, _, marks, _ in self.templates])

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """(name, coverage, matched words, first and last place in the text's words, words in the text)."""
        out, tokens = [], words(text)
        have = self.marks.intersection(tokens)
        for name, t, marks, missing in self.templates if have else ():
            if marks.isdisjoint(have):
                continue
            stretches: list[list[int]] = []
            for k, w in enumerate(tokens):
                if w in marks:
                    lo, hi = max(0, k - 2 * len(t)), min(len(tokens), k + 2 * len(t) + 1)
                    if stretches and lo <= stretches[-1][1]:
                        stretches[-1][1] = hi
                    else:
                        stretches.append([lo, hi])
            hits = []
            for lo, hi in stretches:
                found = [[(lo + x, y) for x, y in align(tokens[lo:hi], t)], *self._around(tokens, lo, hi, t, marks, missing)]
                for pairs in (densest(f, 2 * len(t)) for f in found):
                    if len(pairs) >= self.coverage * len(t) - 1e-9:
                        hits.append((-len(pairs), pairs[-1][0] - pairs[0][0], pairs[0][0]))
            for n, more, first in apart(hits):
                out.append((name, -n / len(t), -n, first, first + more, len(tokens)))
        return out

    def _around(self, tokens: list[str], lo: int, hi: int, t: list[str], marks: frozenset[str], missing: int) -> Iterator[list[tuple[int, int]]]:
        """What aligns on both sides of each mark from lo to hi, with the mark itself."""
        need, whole = self.coverage * len(t) - 1e-9, Counter(t)
        places = {w: [k for k, x in enumerate(t) if x == w] for w in marks}
        at: dict[str, list[int]] = {w: [] for w in marks}
        for k in range(lo, hi):
            if tokens[k] in marks:
                at[tokens[k]].append(k)
        for w, found in at.items():
            for n, k in enumerate(found):
                p, q = max(lo, k - 2 * len(t)), min(hi, k + 2 * len(t) + 1)
                if (whole & Counter(tokens[p:q])).total() < need:
                    continue
                before, after = (found[n - 1] + 1 if n else p), (found[n + 1] if n + 1 < len(found) else q)
                for j in places[w]:
                    begins = {max(p, b) for b in (p, k - j, k - j - missing, before)}
                    ends = {min(q, e) for e in (q, k + len(t) - j, k + len(t) - j + missing, after)}
                    left = [[(b + x, y) for x, y in align(tokens[b:k], t[:j])] for b in begins]
                    right = [[(k + 1 + x, j + 1 + y) for x, y in align(tokens[k + 1 : e], t[j + 1 :])] for e in ends]
                    yield from ([*x, (k, j), *y] for x in left for y in right if len(x) + len(y) + 1 >= need)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(id, license_id, coverage, matched_words, first_word, last_word, text_words) of each template found in a text."""
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.id, b.text, strict=True) for hit in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["id", "license_id", "coverage", "matched_words", "first_word", "last_word", "text_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "id long, license_id string, coverage double, matched_words long, first_word long, last_word long, text_words long"
    return in_small_batches(rows).mapInPandas(releasing(run), kind).withColumnRenamed("id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return find_licenses(read(spark, sf_dir, "documents"))
