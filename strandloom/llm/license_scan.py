"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates are cut into words; of every ``WINDOW`` neighbouring runs of ``GRAM`` words the one of least hash is a
fingerprint, so any passage of ``GRAM + WINDOW - 1`` words of a template holds one. The inverted index gives each
fingerprint's templates and places. A document's runs that are in the index vote for where a template may begin; each such
place is aligned with the template's words inside a band, and a match reports the share of the template's words found in
order (coverage) and the span of the document, in characters, from the first to the last of them.

The index holds the templates alone, which are a parameter, so it is sent with the code; documents are never shuffled.

Defined results: words are runs of ASCII letters and digits, lower-cased; a null or empty text matches nothing; a template
may match several times in a text, in places that do not overlap; matches inside the span of a longer one are left out; a
match needs ``coverage`` (0.8) of its template's words in order, within ``band`` words of their places; a column of ``df``
named as the result is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
_word = re.compile(r"[a-z0-9]+")

#: Notices in common use and the grant of the MIT License.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit-notice": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved.",
}

MATCHES = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"


def _hash(code: int) -> int:
    return xxhash.xxh64_intdigest(code.to_bytes(16, "little"))


class Index:
    """Fingerprints of templates, each with its (template, place)s."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names, self.gram = [*templates], gram
        self.words = [_word.findall(t.lower()) for t in templates.values()]
        if any(len(w) < gram for w in self.words):
            raise ValueError(f"a template needs {gram} words or more")
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.base = len(self.ids) + 1
        if self.base**gram >= 1 << 63:
            raise ValueError("too many words for runs of this length")
        self.coded = [[self.ids[w] for w in t] for t in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.coded):
            codes = self.codes(np.array(t, np.int64)).tolist()
            for s in range(max(1, len(codes) - window + 1)):
                at = min(range(s, min(len(codes), s + window)), key=lambda i: (_hash(codes[i]), i))
                if (k, at) not in self.places[codes[at]]:
                    self.places[codes[at]].append((k, at))
        self.known = np.array(sorted(self.places), np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        out = np.zeros(max(n, 0), np.int64)
        for k in range(self.gram):
            out = out * self.base + ids[k : k + len(out)]
        return out

    def scan(self, text: str | None, band: int = BAND, coverage: float = COVERAGE) -> list[dict]:
        if not text:
            return []
        low, get = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), self.ids.get
        ids = np.array([get(w, 0) for w in _word.findall(low)], np.int64)
        if len(ids) < self.gram:
            return []
        codes = self.codes(ids)
        hits = np.flatnonzero(np.isin(codes, self.known))
        if not len(hits):
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for i in hits.tolist():
            for k, at in self.places.get(int(codes[i]), ()):
                starts[k].append(i - at)
        found, spots = [], [m.span() for m in _word.finditer(low)]
        for k, where in starts.items():
            own, free = self.coded[k], 0
            for s in sorted({x for x in where if x > -len(own)}):
                if s + len(own) <= free:  # aligned already
                    continue
                got = align(own, ids, s, band, free)
                if got and len(got) >= coverage * len(own):
                    found.append((got[0], got[-1], k, len(got) / len(own)))
                    free = got[-1] + 1
        found.sort(key=lambda x: (x[0] - x[1], x[0], self.names[x[2]]))
        kept: list[tuple] = []
        for a, b, k, c in found:
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, k, c))
        return [{"license": self.names[k], "coverage": c, "start": spots[a][0], "end": spots[b][1]} for a, b, k, c in sorted(kept)]


def align(own: list[int], ids: np.ndarray, start: int, band: int, free: int = 0) -> list[int]:
    """The document places of the template's words in the best alignment near ``start``: most words found in order, then
    the earliest; a word may be ``band`` places off at most, and none stands before ``free``."""
    low = max(free, start - band)
    text = ids[low : max(0, start + len(own) + band)].tolist()
    shift = start - low  # the template's word j is looked for at j + shift in the slice, give or take the band
    rows: list[dict[int, tuple[int, int]]] = []
    best: dict[int, tuple[int, int]] = {}  # slice place: (words found up to there, place of the last found + 1)
    for j, w in enumerate(own):
        now: dict[int, tuple[int, int]] = {}
        for p in range(max(0, j + shift - band), min(len(text), j + shift + band + 1)):
            left = now.get(p - 1, (0, 0))
            up = best.get(p, best.get(max(best, default=0), (0, 0)) if best and p > max(best) else (0, 0))
            cell = max(left, up, key=lambda c: c[0])
            if text[p] == w:
                back = best.get(p - 1, best.get(max(best), (0, 0)) if best and p - 1 > max(best) else (0, 0))
                if back[0] + 1 > cell[0]:
                    cell = (back[0] + 1, p + 1)
            now[p] = cell
        rows.append(now)
        best = now
    out, p = [], max(best, default=-1)
    for j in range(len(own) - 1, -1, -1):
        now = rows[j]
        if not now:
            continue
        p = min(p, max(now))
        if p < min(now):
            continue
        above = rows[j - 1] if j else {}
        up = above.get(p, above.get(max(above), (0, 0)) if above and p > max(above) else (0, 0))
        n, last = now[p]
        if n > up[0] and last:
            out.append(last - 1 + low)
            p = last - 2
    return out[::-1]


def scan(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, into: str = "licenses", band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """``df`` with the matches of each text."""
    index = Index(TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([index.scan(t, band, coverage) for t in texts.to_pylist()], kind)

    return df.withColumn(into, run(F.col(f"`{text_col}`")))
