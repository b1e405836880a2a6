"""License scans by patience alignment of texts with license templates.

Words of text and template are compared in lower case without punctuation. Alignment
anchors on the words that occur once in both, keeps the longest increasing run of them
and does the same in every gap between anchors; a gap without such words takes what
agrees at its two ends. Coverage is the share of the template's words that are aligned.

A notice may occur anywhere and more than once in a long text. A match that starts at some
word leaves out at most the words that the coverage spares, so it starts with one of the
template's first words; from there a window of ``SLACK`` template lengths must hold enough
of the template's words (counted with repeats). Each such start is aligned, so stray
template words before a notice cost it nothing: a verbatim notice always has coverage 1.

Every text is scanned whole by the task that reads it; nothing is shuffled.

Defined results: null text counts as empty and has no match; a text may match several
templates, the best one has the highest coverage, then the most words, then the first
name; matches of one template do not overlap, the one with more words stays, of equals the
closest, then the first; repeated rows are scanned alike; an empty table gives no rows.
"""

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, functions as F

COVERAGE = 0.8
SLACK = 1.5             # a window is so many times as long as the template

# Public license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT-line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT.""",
    "Reserved-line": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list:
    return WORD.findall(text.lower())


def longest_increasing(values) -> list:
    """Places of a longest strictly increasing run."""
    tops, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a, b) -> list:
    """Aligned places (i, j) with a[i] == b[j], increasing in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and cb.get(w) == 1}
        pairs = [(at[w], j) for j, w in enumerate(b[b0:b1], b0) if w in at]
        anchors = [pairs[k] for k in longest_increasing([i for i, _ in pairs])]
        if not anchors:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                found.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                found.append((a1, b1))
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def starts(hits, need: int, width: int, template: Counter, head):
    """Places of the hits in ``head`` whose window of ``width`` words holds ``need`` template words.

    ``hits`` are (place, word) of the text's words that the template has; words count with
    repeats up to the template's. The window slides by one hit, so none is passed over.
    """
    seen, got, right = Counter(), 0, 0
    for place, w in hits:
        while right < len(hits) and hits[right][0] < place + width:
            v = hits[right][1]
            seen[v] += 1
            got += seen[v] <= template[v]
            right += 1
        if got >= need and w in head:
            yield place
        got -= seen[w] <= template[w]
        seen[w] -= 1


def notices(ws, hits, t, counts, need: int):
    """[(matched words, first word, last word)] of one template, apart from each other.

    Every start is aligned that is not inside a verbatim notice. The alignment with the most
    words is a match, of equals the closest, then the first; those that overlap it go, and so
    on with the rest.
    """
    width, head = max(len(t) + 2, int(len(t) * SLACK)), set(t[:len(t) - need + 1])
    found, done = [], -1
    for lo in starts(hits, need, width, counts, head):
        if lo <= done:
            continue
        got = align(ws[lo:lo + width], t)
        if len(got) >= need:
            found.append((len(got), lo + got[0][0], lo + got[-1][0]))
            if len(got) == len(t) and got[-1][0] == len(t) - 1:
                done = lo + len(t) - 1
    out, firsts = [], []
    for m in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
        k = bisect_left(firsts, m[1])
        if (k == 0 or out[k - 1][2] < m[1]) and (k == len(out) or m[2] < firsts[k]):
            out.insert(k, m)
            firsts.insert(k, m[1])
    return out


def matches(text: str, templates, coverage: float = COVERAGE):
    """[(name, coverage, matched words, first word, last word)] of one text; see ``prepared``."""
    ws, out = words(text), []
    per = {}
    for name, (t, counts) in templates.items():
        for w in counts:
            per.setdefault(w, []).append(name)
    hits = {}
    for i, w in enumerate(ws):
        for name in per.get(w, ()):
            hits.setdefault(name, []).append((i, w))
    for name, h in hits.items():
        t, counts = templates[name]
        need = -(-int(coverage * 1000) * len(t) // 1000)
        if len(h) >= need:
            out += [(name, n / len(t), n, lo, hi) for n, lo, hi in notices(ws, h, t, counts, need)]
    return sorted(out, key=lambda m: (-m[1], -m[2], m[0], m[3]))


def prepared(templates: dict) -> dict:
    """name -> (words, counts); templates without words are left out."""
    out = {name: words(t) for name, t in templates.items()}
    return {name: (t, Counter(t)) for name, t in out.items() if t}


def scanned(docs: DataFrame, templates=None, coverage: float = COVERAGE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, license (best or null), coverage, n_matches, spans.

    ``spans`` lists every match as name:first word:last word, by coverage.
    """
    import pyarrow as pa
    ready = prepared(TEMPLATES if templates is None else templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
                        ("n_matches", pa.int64()), ("spans", pa.string())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, texts = b.column("id").slice(lo, 256), b.column("t").slice(lo, 256).to_pylist()
                found = [matches(t or "", ready, coverage) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([f[0][0] if f else None for f in found], pa.string()),
                    pa.array([round(f[0][1], 6) if f else 0.0 for f in found], pa.float64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(f"{n}:{a}:{z}" for n, _, _, a, z in f) for f in found], pa.string())], schema=schema)

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id bigint, license string, coverage double, n_matches bigint, spans string")
