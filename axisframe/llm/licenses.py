"""License scans by a positional index of rare words.

Every template's rarest words by IDF (over templates) are indexed by position. A template that is to be covered must
have one of its highest-IDF words in the file, those that weigh more than it may lack; so a file's licence words are
looked up from the highest IDF down, and templates none of whose key words are there are never touched. For the others
the words' places are intersected by relative position: hits (template, place in the template, start of the template in
the file) in the order of both texts whose starts move by a few words at most from one to the next form a chain, so
words may be put in or left out. A chain that covers enough of the weight of the template's rare words is a match if
the template's mandatory phrases all stand inside the matched stretch.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, new_key, once_per_process

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License notices (public wording) by label, with the phrases that must stand in a match.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "without restriction")),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms",)),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee",)),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "except in compliance with the license")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "free software foundation")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software released into the public domain",)),
    ("gpl-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "free software foundation")),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ("any person or organization obtaining a copy",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ("without a written agreement",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license",)),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("mit-line", "Released under the MIT License", ("mit license",)),
]

WORD = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, then runs of bytes that are digits, a-z or beyond ASCII (the same runs in UTF-8 as in code points)."""
    return text.encode().translate(WORD).split()


class Index:
    def __init__(self, base: dict[str, str], templates, cover: float, rare: int, drift: int = 3):
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
        self.cover, self.drift = cover, drift
        self.templates = []
        df: Counter = Counter()
        parsed = [(label, words_of(text), [words_of(p) for p in musts]) for label, text, musts in templates]
        for _, w, _ in parsed:
            df.update(set(w))
        self.idf = {w: math.log((1 + len(parsed)) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys: dict[bytes, list[int]] = defaultdict(list)
        for t, (label, w, musts) in enumerate(parsed):
            # the template's rarest words by IDF carry it; ties by place
            chosen = sorted(range(len(w)), key=lambda i: (-self.idf[w[i]], i))[:rare]
            full = 0.0
            for i in sorted(chosen):
                self.postings[w[i]].append((t, i))
                full += self.idf[w[i]]  # in the order in which a chain adds it up
            self.templates.append((label, len(w), full, [b" " + b" ".join(m) + b" " for m in musts]))
            # its key words: without all of them what is left covers too little
            weight: Counter = Counter()
            for i in chosen:
                weight[w[i]] += self.idf[w[i]]
            spare = (1 - cover) * full + 1e-9
            for x in sorted(weight, key=lambda x: (-self.idf[x], x)):
                if spare < 0:
                    break
                self.keys[x].append(t)
                spare -= weight[x]
        self.lookup = sorted(self.keys, key=lambda x: (-self.idf[x], x))  # the order in which a file's words are looked up

    def bases(self, joined: bytes) -> tuple[int, int | None, int | None, set[str]]:
        """Places of base phrases: how many, the first and last word, labels. Spaces are counted once for each phrase."""
        n, first, last, found = 0, None, None, set()
        for phrase, label in self.base:
            at, counted, place = joined.find(phrase), 0, 0
            while at >= 0:
                place += joined.count(b" ", counted, at)
                counted = at
                first, last = place if first is None else min(first, place), place if last is None else max(last, place)
                n += 1
                found.add(label)
                at = joined.find(phrase, at + 1)
        return n, first, last, found

    def candidates(self, there: set[bytes]) -> set[int]:
        """Templates that a file of these words may hold: found by their key words, weighed by all they share."""
        found: set[int] = set()
        for x in self.lookup:
            if x in there:
                found.update(self.keys[x])
        weight = [0.0] * len(self.templates)
        for x in there & self.postings.keys() if found else ():
            for t, _ in self.postings[x]:
                weight[t] += self.idf[x]
        return {t for t in found if self.templates[t][2] > 0 and weight[t] >= self.cover * self.templates[t][2] - 1e-9}

    def scan(self, text: str):
        w = words_of(text)
        joined = b" " + b" ".join(w) + b" "
        n, first, last, base = self.bases(joined)
        labels, best = set(base), 1.0 if base else 0.0
        there = set(w)
        open_to = self.candidates(there)
        if open_to:
            near = {x: [(t, k) for t, k in reversed(self.postings[x]) if t in open_to] for x in there & self.postings.keys()}
            # (template, start): (place in the template, weight, least start) of the best chain that ends there; along one start the later is the better
            ends: dict[tuple[int, int], list[tuple[int, float, int]]] = defaultdict(list)
            for i, x in enumerate(w):
                if x not in near:
                    continue
                weight = self.idf[x]
                for t, k in near[x]:  # from the highest place down: a word of the file stands in a chain once
                    start = i - k
                    got, least = 0.0, start
                    for other in range(start - self.drift, start + self.drift + 1):
                        for end in reversed(ends.get((t, other), ())):
                            if end[0] < k:
                                if end[1] > got:
                                    got, least = end[1], min(start, end[2])
                                break
                    got += weight
                    ends[t, start].append((k, got, least))
                    label, length, full, musts = self.templates[t]
                    if got >= self.cover * full and (label not in labels or got / full > best):
                        stretch = b" " + b" ".join(w[max(0, least - self.drift) : start + length + self.drift]) + b" "
                        if all(m in stretch for m in musts):
                            labels.add(label)
                            best = max(best, min(1.0, got / full))
        return len(w), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=None, templates=None, cover: float = 0.7, rare: int = 24) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts every place of every base phrase, overlapping ones too; first and last are null if there are
    none. A match needs ``cover`` of the IDF weight of the template's ``rare`` rarest words in one chain: in the
    template's order, each once, with at most 3 words put in or left out between one and the next. Its mandatory
    phrases must stand unbroken. ``score``: 1 with a base phrase, else the best match's share of the weight, else 0.
    Null texts count as empty: no words, no labels. Time is linear in the text. Templates are a fixed list, not data.
    Repeated rows are each scanned; other columns are ignored; an empty table gives an empty one.
    """
    spec = (base or BASE, templates or TEMPLATES, cover, rare)
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = once_per_process("licenses", key, lambda: Index(*spec)).scan
        for batch in batches:
            got = [scan(t.as_py() or "") for t in batch.column(1)]
            cols = list(zip(*got, strict=True)) if got else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    pick = docs.select(id_col, text_col)
    return pick.mapInArrow(lean(run), f"`{id_col}` {pick.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
