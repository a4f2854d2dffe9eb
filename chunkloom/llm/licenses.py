"""Licence scans by sentence rules.

Known licence sentences have identifiers.  A document's sentences are normalised (lower case, words only) and those
that are known become a sequence of identifiers; ordered rules map runs of that sequence to licences.  A sentence begins after a line
break or the end of another sentence and ends at either, and line breaks inside it don't matter, so both one-line
notices and wrapped headers are read.  Longer rules go first and use up what they match; known sentences
that no rule takes are reported as ``unmatched``.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.common import _Q, Words, columns, slices, span_hash

#: identifier -> wordings of the sentence.
SENTENCES: dict[str, list[str]] = {
    "apache2-short": ["Licensed under the Apache License, Version 2.0."],
    "apache2-grant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache2-full": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-nowarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ccbync4-short": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under CC BY-NC 4.0."],
    "ccby4-short": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under CC BY 4.0."],
    "ccbysa4-short": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-nowarranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-see": ["See the GNU Lesser General Public License for more details."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-see": ["See the GNU Affero General Public License for more details."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-short": ["Licensed under the ISC License.", "This project is licensed under the ISC License."],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0-short": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal."],
    "epl2-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsl1-short": ["Distributed under the Boost Software License, Version 1.0."],
    "rights": ["All rights reserved."],
}

#: (licence, identifiers in order), the first that matches a place wins; sorted by length, then as listed.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-full", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-asis", "apache2-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-nowarranty", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-nowarranty", "gpl-see", "gpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-nowarranty", "agpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-nowarranty", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-nowarranty", "lgpl-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Apache-2.0", ("apache2-full",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("CC-BY-NC-4.0", ("ccbync4-short",)),
    ("CC-BY-4.0", ("ccby4-short",)),
    ("CC-BY-SA-4.0", ("ccbysa4-short",)),
    ("MPL-2.0", ("mpl2",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-short",)),
    ("Unlicense", ("unlicense-domain",)),
    ("CC0-1.0", ("cc0-short",)),
    ("EPL-2.0", ("epl2-short",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-short",)),
    ("all-rights-reserved", ("rights",)),
]


def load(path: str) -> tuple[dict[str, list[str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules from a JSON file: {"sentences": {identifier: [wording, ...]}, "rules": [[licence, [identifier, ...]], ...]}.

    A rule that names an unknown identifier, or none, is an error.
    """
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    sentences = {name: [w] if isinstance(w, str) else list(w) for name, w in raw["sentences"].items()}
    rules = [(licence, tuple(names)) for licence, names in raw["rules"]]
    for licence, names in rules:
        if not names or (unknown := set(names) - sentences.keys()):
            raise ValueError(f"the rule for {licence} names {', '.join(sorted(unknown)) if names else 'no sentence'}")
    return sentences, rules


class Scanner:
    """Known sentences by number of words and hash; rules by their first identifier."""

    def __init__(self, sentences: Mapping[str, Sequence[str]], rules: Sequence[tuple[str, tuple[str, ...]]]):
        self.names = sorted(sentences)
        number = {n: i for i, n in enumerate(self.names)}
        known: dict[int, dict[int, int]] = defaultdict(dict)
        lead = []
        for name in self.names:
            for s in sentences[name]:
                w = Words(pa.array([s]))
                n = len(w.hash)
                if n:
                    known[n][int(span_hash(w.hash, np.array([0]), np.array([n]), _Q)[0])] = number[name]
                    lead.append(int(w.hash[0]))
        self.known = {n: (np.array(sorted(d), dtype=np.uint64), np.array([d[h] for h in sorted(d)])) for n, d in known.items()}
        self.lead = np.unique(np.array(lead, dtype=np.uint64))
        self.rules: dict[int, list[tuple[str, tuple[int, ...]]]] = defaultdict(list)
        for licence, ids in sorted(rules, key=lambda r: -len(r[1])):
            self.rules[number[ids[0]]].append((licence, tuple(number[i] for i in ids)))

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, number of the first word in its text, sentence) of each known sentence, in order, without overlaps.

        Where several begin at a word the longest is taken; one that begins inside another is left out.
        """
        w = Words(column)
        n = len(w.hash)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        raw = w.data
        # A byte ends a sentence if it is a line break, or a full stop and the like before white space or the end.
        blank = np.append(np.isin(raw, [9, 10, 11, 12, 13, 32]), True)
        stop = np.isin(raw, [33, 46, 58, 59, 63]) & blank[1:]
        inner = w.off[1:-1]
        edge = np.isin(raw, [10, 13]) | stop
        last = inner[(inner > 0) & (inner <= len(raw))] - 1
        edge[last] |= np.isin(raw[last], [33, 46, 58, 59, 63])
        upto = np.append(0, np.cumsum(edge))
        doc = np.repeat(np.arange(len(column)), w.counts)
        prev_end = np.append(0, w.end[:-1])
        opens = upto[w.start] > upto[prev_end]
        first = w.first[:-1][w.counts > 0]
        opens[first] = True
        closes = np.append(opens[1:], True)
        begin = np.flatnonzero(opens & np.isin(w.hash, self.lead))
        got_at, got_end, got_id = [], [], []
        for size, (hashes, ids) in self.known.items():
            b = begin[begin + size <= w.first[1:][doc[begin]]]
            b = b[closes[b + size - 1]]
            h = span_hash_at(w.hash, b, size)
            pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            ok = hashes[pos] == h
            got_at.append(b[ok])
            got_end.append(b[ok] + size)
            got_id.append(ids[pos[ok]])
        at, end, name = (np.concatenate(x) for x in (got_at, got_end, got_id))
        keep, free = [], -1
        for k in np.lexsort((-end, at)):
            if at[k] >= free:
                keep.append(k)
                free = end[k]
        keep = np.array(keep, dtype=np.int64)
        return doc[at[keep]], at[keep] - w.first[:-1][doc[at[keep]]], name[keep]

    def match(self, ids: Sequence[int]) -> list[tuple[str, int, int]]:
        """(licence, first, behind last) over a sequence of identifiers; longer rules go first wherever they match."""
        taken = [False] * len(ids)
        out = []
        sizes = sorted({len(r[1]) for rs in self.rules.values() for r in rs}, reverse=True)
        for size in sizes:
            i = 0
            while i + size <= len(ids):
                hit = None
                if not any(taken[i : i + size]):
                    hit = next((lic for lic, r in self.rules.get(ids[i], ()) if len(r) == size and tuple(ids[i : i + size]) == r), None)
                if hit:
                    taken[i : i + size] = [True] * size
                    out.append((hit, i, i + size))
                i += size if hit else 1
        out += [("unmatched", i, i + 1) for i, t in enumerate(taken) if not t]
        return sorted(out, key=lambda x: x[1])


def span_hash_at(values: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    return span_hash(values, begin, begin + size, _Q) if len(begin) else np.zeros(0, dtype=np.uint64)


def licences(docs: DataFrame, sentences: Mapping[str, Sequence[str]] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_word, sentences) for each rule's match, and each known sentence without one.

    ``first_word`` counts the document's words from 0; ``sentences`` are the matched identifiers.  Texts that are null, empty or without known
    sentences give no rows.  Repeated rows give repeated rows, a null id is reported as null.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(sentences, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            for lo, hi in slices(b.column(1)):
                doc, word, name = s.sentences(b.column(1).slice(lo, hi - lo))
                rows, what, at, names = [], [], [], []
                cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else []
                for x, y in zip(cuts, cuts[1:]):
                    for licence, i, j in s.match(name[x:y].tolist()):
                        rows.append(lo + int(doc[x]))
                        what.append(licence)
                        at.append(int(word[x + i]))
                        names.append([s.names[k] for k in name[x + i : x + j]])
                if rows:
                    out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(what, pa.string()), pa.array(at, pa.int64()), pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "license", "first_word", "sentences"])

    return columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, license string, first_word bigint, sentences array<string>")
