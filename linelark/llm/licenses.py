"""License scans by patience alignment: how much of each license template a text holds, word by word.

Words unique to both sides anchor the alignment, the longest increasing subsequence of the anchors is kept, and each gap
between anchors is aligned in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_rows

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Share of a template's words that a match has at least, and other words between two of them at most.
COVERAGE, GAP = 0.9, 20

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "All-rights-reserved": "All rights reserved",
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, last, back = [], [], []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[p], last[p] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (position in a, position in b) of words that patience alignment matches, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        anchors = [(j, where[w]) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in where]
        kept = [anchors[i] for i in _increasing([i for _, i in anchors])]
        if not kept:
            continue
        pa, pb = a0, b0
        for j, i in kept:
            todo.append((pa, i, pb, j))
            out.append((i, j))
            pa, pb = i + 1, j + 1
        todo.append((pa, a1, pb, b1))
    return sorted(out)


class Scanner:
    """Finds copies of templates. Words of a copy are at most ``gap`` apart (for a shorter template as many as it has words), so
    every copy lies in one stretch of the text whose template words are no further apart, however long it is.

    Words unique in a stretch and in the template anchor its alignment. Where a stretch holds several copies no word may be
    unique; then what lies between the neighbours of each place of a rarer word is aligned, where that word is unique.
    """

    def __init__(self, templates: dict[str, str], coverage: float, gap: int = GAP) -> None:
        self.coverage, self.gap = coverage, gap
        parts = [(name, w, Counter(w)) for name, text in sorted(templates.items()) if (w := words_of(text))]
        common = Counter(w for _, _, c in parts for w in c)
        # the words to look for: with more than (1 - coverage) of a template's words, one of them is in any good match
        self.templates = []
        for name, words, counts in parts:
            cues, n = [], 0
            for w in sorted(counts, key=lambda w: (-len(w), common[w], w)):
                cues.append(w)
                n += counts[w]
                if n > (1 - coverage) * len(words):
                    break
            self.templates.append((name, words, counts, cues))
        self.cues = frozenset(c for t in self.templates for c in t[3])

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word + 1) of the best match of each template that is covered enough.

        Of equal coverage the shortest match counts, then the first.
        """
        words = words_of(text)
        present = set(words)
        if not present & self.cues:
            return []
        at: dict[str, list[int]] = {}
        found = []
        for name, template, counts, cues in self.templates:
            least = self.coverage * len(template) - 1e-9
            if sum(n for w, n in counts.items() if w in present) < least:
                continue
            if not at:
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
            if sum(min(n, len(at.get(w, ()))) for w, n in counts.items()) < least:
                continue
            best = max((m for places in self._stretches(template, counts, at) for m in self._matches(template, counts, cues, words, places, least)), key=lambda m: (m[0], m[1] - m[2], -m[1]), default=None)
            if best:
                found.append((name, best[0] / len(template), best[1], best[2]))
        return found

    def _stretches(self, template: list[str], counts: Counter, at: dict[str, list[int]]) -> list[list[int]]:
        """Places of the template's words in the text, split where two are too far apart."""
        gap, out = min(self.gap, len(template)), []
        for i in sorted(i for w in counts for i in at.get(w, ())):
            if out and i - out[-1][-1] - 1 <= gap:
                out[-1].append(i)
            else:
                out.append([i])
        return out

    def _matches(self, template: list[str], counts: Counter, cues: list[str], words: list[str], places: list[int], least: float) -> list[tuple[int, int, int]]:
        """(matched words, first, last + 1) of the copies found in a stretch."""
        own = [words[p] for p in places]
        held = Counter(own)
        if sum((held & counts).values()) < least:
            return []
        out = self._aligned(template, own, places, least)
        if out and out[0][0] == len(template):
            return out
        for cue in cues:
            if held[cue] > counts[cue]:
                here = [i for i, w in enumerate(own) if w == cue]
                bounds = [-1] * counts[cue] + here + [len(own)] * counts[cue]
                for n in range(len(here)):
                    low, high = bounds[n] + 1, bounds[n + 2 * counts[cue]]
                    if sum((Counter(own[low:high]) & counts).values()) >= least:
                        out += self._aligned(template, own[low:high], places[low:high], least)
        return out

    def _aligned(self, template: list[str], own: list[str], places: list[int], least: float) -> list[tuple[int, int, int]]:
        """The longest run of matched words that are not too far apart, if it is long enough."""
        gap, runs = min(self.gap, len(template)), []
        for p in (places[j] for _, j in align(template, own)):
            if runs and p - runs[-1][-1] - 1 <= gap:
                runs[-1].append(p)
            else:
                runs.append([p])
        best = max(runs, key=len, default=[])
        return [(len(best), best[0], best[-1] + 1)] if best and len(best) >= least else []


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """For each row of ``documents``: doc_id, n_licenses, best (license of the highest coverage, ties to the longer match, then the later name), coverage, licenses (name, coverage, first and last word).

    The whole text is scanned. A match has ``coverage`` of a template's words in order, with at most ``gap`` other words (and no
    more than the template has) between two of them. Null, empty and unlicensed texts: n_licenses 0, best null, coverage 0, no licenses. Repeated
    rows repeat; other columns are ignored; an empty table gives no rows. A template may be a part of a longer one; both count.
    """
    known = dict(templates if templates is not None else TEMPLATES)

    def start():
        scanner = Scanner(known, coverage, gap)

        def one(doc_id, text):
            found = scanner.scan(text)
            best = max(found, key=lambda f: (f[1], f[3] - f[2], f[0]), default=None)
            return doc_id, len(found), best and best[0], best[1] if best else 0.0, [{"license": n, "coverage": c, "first": a, "last": b - 1} for n, c, a, b in found]

        return one

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, start, "doc_id long, n_licenses int, best string, coverage double, licenses array<struct<license:string,coverage:double,first:int,last:int>>")
