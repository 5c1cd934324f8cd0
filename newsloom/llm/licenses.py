"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment decides.

A text is read in windows of several lengths, each for templates of about that length, overlapping so
that any passage of a template's length lies whole in one of its windows. A window's MinHash over
its word shingles has BANDS bands of one row: it meets a template when any of the minima agree. A
window that holds a template whole has at least MIN_JACCARD of its shingles in common with it, so it
is missed with a probability below (1 - MIN_JACCARD) ** BANDS, 2e-8. A template counts as found in a
window that holds at least MIN_CONTAINED of its shingles. Windows without a single shingle of any
template cannot agree in a minimum, and are not hashed.

Of a template that is found, every run of its shingles no longer than its windows that holds enough
of them is a possible place. Shingles in the notice's own order count for a run and words between
them against it, so a run stops at the end of its notice and does not reach into the next one.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SHINGLE = 3
BANDS = 64
MIN_JACCARD = 0.24
MIN_CONTAINED = 0.8
# What a shingle that is foreign or out of order takes from a run, in shingles of the notice; a word put
# into a notice makes three foreign ones, which one shingle behind them outweighs.
FOREIGN = 0.25
LENGTHS = (4, 8, 16, 32, 64, 128, 256, 512)

# Notices by which works state their license (license, notice).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without permission."),
]
# Bare rights notices; no license, but a statement of rights that op6 reports as well.
RIGHTS = [("reserved", "All rights reserved.")]
FOUND = "array<struct<license: string, start: int, end: int, containment: double>>"


class _Hashes(dict):
    """64-bit hash by word; forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        self[word] = h = (crc32(raw) << 32 | crc32(raw[::-1] + b"#")) ^ len(raw)
        return h


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.hashes = _Hashes()
        r = np.random.default_rng(5)
        self.factors = r.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, self.orders, self.by_length, self.bands = [], [], [], {}, {}
        for name, notice in templates:
            ws = WORD.findall(notice.lower())
            ordered = self._shingles(ws)
            shingles = np.unique(ordered)
            if not len(shingles):
                continue
            k = len(self.names)
            self.names.append(name)
            self.sets.append(shingles)
            order: dict[int, list[int]] = {}  # where a shingle stands in the notice, last place first
            for j in range(len(ordered) - 1, -1, -1):
                order.setdefault(int(ordered[j]), []).append(j)
            self.orders.append(order)
            length = next((n for n in LENGTHS if n - max(1, n // 8) + 1 >= len(ws)), 2 * len(ws))
            self.by_length.setdefault(length, []).append(k)
            for band, low in enumerate(self._minima(shingles).tolist()):
                self.bands.setdefault((length, band, low), []).append(k)
        # Notices that are a piece of another one of the same license.
        self.pieces = [any(n == name and len(x) > len(own) and np.isin(own, x).all()
                           for n, x in zip(self.names, self.sets)) for name, own in zip(self.names, self.sets)]
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def _shingles(self, ws: list[str]) -> np.ndarray:
        """The hash of every shingle in order; of fewer words, none."""
        if len(ws) < SHINGLE:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, ws), np.uint64, len(ws))
        h = np.zeros(len(ws) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            h = (h ^ w[j:len(h) + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
            h ^= h >> np.uint64(29)
        return h

    def _minima(self, shingles: np.ndarray) -> np.ndarray:
        mixed = shingles[:, None] * self.factors
        return (mixed ^ (mixed >> np.uint64(31))).min(0)

    def _runs(self, k: int, positions: list[int], hashes: list[int], reach: int) -> Iterator[tuple]:
        """(score, containment, first, last) of the runs that hold enough of template ``k``, from each of
        its shingles in a text to each later one that adds to the run, at most ``reach`` on. The score
        is 1 for the notice as it is, from its first to its last shingle."""
        order, different = self.orders[k], len(self.sets[k])
        total = sum(map(len, order.values()))
        for i, first in enumerate(positions):
            end = bisect_left(positions, first + reach)
            if (end - i) / different < MIN_CONTAINED:
                continue
            seen: set[int] = set()
            tails: list[int] = []  # of rising places in the notice: as many as the run has in order
            for h, last in zip(hashes[i:end], positions[i:end]):
                before = len(seen) + len(tails)
                seen.add(h)
                for place in order[h]:
                    at = bisect_left(tails, place)
                    tails[at:at + 1] = [place]
                share = len(seen) / different
                if share >= MIN_CONTAINED and len(seen) + len(tails) > before:
                    foreign = last - first + 1 - len(tails)
                    yield (len(tails) - FOREIGN * foreign) / total, share, first, last

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, start, end, containment) of each place, in order; start and end are code points.
        Of places that overlap, the one that is most like its notice stands, then the one of the longer
        notice, then the shortest, then the first; a notice that is a piece of another one of its license
        stands only where no other does."""
        low = text.lower()
        ws = WORD.findall(low)
        hs = self._shingles(ws)
        at = np.flatnonzero(self.flags[(hs >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(hs[at], self.known)]
        if not len(at):
            return []
        found: dict[int, int] = {}
        for length, _ in self.by_length.items():
            step, reach = max(1, length // 8), length - SHINGLE + 1
            first = np.maximum(0, (at - reach) // step)
            starts = np.unique(np.concatenate([(first + j) for j in range(reach // step + 2)])) * step
            for start in starts[starts < len(hs)].tolist():
                window = np.unique(hs[start:start + reach])
                met = {k for band, low_ in enumerate(self._minima(window).tolist())
                       for k in self.bands.get((length, band, low_), ())}
                for k in met:
                    if np.isin(self.sets[k], window, assume_unique=True).mean() >= MIN_CONTAINED:
                        found[k] = reach
        if not found:
            return []
        places = []
        for k, reach in found.items():
            own = at[np.isin(hs[at], self.sets[k])]
            for score, share, a, b in self._runs(k, own.tolist(), hs[own].tolist(), reach):
                places.append((self.pieces[k], -score, -len(self.sets[k]), b - a, a, b + SHINGLE, self.names[k], share))
        # Lower case can change a text's length, so places are told in words of the text itself.
        spans = [m.span() for m in WORD.finditer(text)]
        if len(spans) != len(ws):
            spans = [m.span() for m in WORD.finditer(low)]
        out: list[tuple] = []
        taken = bytearray(len(ws))
        for *_, a, b, name, share in sorted(places):
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                out.append((name, spans[a][0], spans[b - 1][1], share))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, start, end (code points) and containment of every place in ``text`` that holds a
    template. NULL, empty and license-free texts give no row; repeated rows give repeated places.
    Templates without three words are left out; without templates nothing is found. Bare rights notices
    are found with ``TEMPLATES + RIGHTS``."""
    held = docs.sparkSession.sparkContext.broadcast(list(templates or TEMPLATES))

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(held.value)
        for texts in batches:
            yield pd.Series([[
                {"license": n, "start": a, "end": b, "containment": c}
                for n, a, b, c in scanner.scan(t or "")] for t in texts], dtype=object)

    return docs.select("doc_id", F.explode(F.pandas_udf(look, FOUND)("text")).alias("m")).select(
        "doc_id", "m.license", "m.start", "m.end", F.round("m.containment", 6).alias("containment"))
