"""License scan: which license wordings a document holds, how completely, and where.

Winnowed word fingerprints of the templates form an inverted index; a document's own fingerprints pick (template,
diagonal) candidates from it, and a banded alignment of each candidate gives the words that match, in order. Templates
are few and fixed, so their index travels with the code; documents are never shuffled.
"""
from bisect import bisect_right

import numpy as np

from kinsift.llm.arrays import PUNCTUATION, grams, pieces, word_hashes, word_spans

K, WINDOW, BAND = 3, 2, 6

#: Wordings by which texts state their license: fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                          "following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_KEEP = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
         "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
         "documentation and/or other materials provided with the distribution. ")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
          "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
          "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
          "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
          "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
          "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
              "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
              "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
              "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_FREE = "free software{} you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
_CC = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."

#: Whole texts of short licenses, without title and copyright line.
TEMPLATES |= {
    "mit-text": TEMPLATES["mit-grant"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
                "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
                "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
                "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
                "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-text": _GRANT + _KEEP + _AS_IS,
    "bsd-3-clause-text": _GRANT + _KEEP + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                         "derived from this software without specific prior written permission. " + _AS_IS,
    "isc-text": _USE + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS,
    "0bsd-text": _USE + ". " + _ISC_AS_IS,
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                 "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Headers and notices of longer licenses.
TEMPLATES |= {
    "lgpl-header": "This library is " + _FREE.format(";", "Lesser"),
    "agpl-header": "This program is " + _FREE.format(":", "Affero"),
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    **{f"cc-by-{k}-4.0-notice": _CC.format(v) for k, v in (("sa", "ShareAlike"), ("nc", "NonCommercial"), ("nd", "NoDerivatives"),
                                                          ("nc-sa", "NonCommercial-ShareAlike"), ("nc-nd", "NonCommercial-NoDerivatives"))},
}

SCHEMA = "license string, coverage double, matched int, template_words int, start long, end long"


def winnow(hashes, k=K, window=WINDOW):
    """Positions of the k-grams that are the smallest of some run of `window` k-grams, the last of equals; and all k-grams."""
    found = grams(hashes, k)
    if len(found) <= window:
        return (np.array([len(found) - 1 - int(np.argmin(found[::-1]))]) if len(found) else np.empty(0, dtype=np.int64)), found
    runs = np.lib.stride_tricks.sliding_window_view(found, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1)), found


class Index:
    """Fingerprint to (template, position) pairs, and the templates' words."""

    def __init__(self, templates):
        self.names = list(templates)
        self.words = [word_hashes([templates[n].encode()], separators=PUNCTUATION)[0] for n in self.names]
        self.bags = [np.unique(hashes, return_counts=True) for hashes in self.words]
        self.places = {}
        for t, hashes in enumerate(self.words):
            at, found = winnow(hashes)
            for i in at:
                self.places.setdefault(int(found[i]), []).append((t, int(i)))
        self.known = np.array(sorted(self.places), dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.known & np.uint64(0xFFFF)] = True


def align(template, words, band=BAND):
    """(matched words, first, last) of the longest common subsequence inside a band.

    `words` starts `band` words before the candidate's diagonal; template word i may meet words i .. i + 2 * band.
    Of equally long matches the shortest span wins, then the one that starts nearest to the diagonal.
    """
    width = 2 * band + 1
    none = (0, 0, 0, 0)
    before = [none] * (width + 1)  # (matched, -span, -distance of the first from the diagonal, first), by offset
    for i, wanted in enumerate(template):
        row = []
        for d in range(width):
            j = i + d
            options = [before[d + 1]]
            if d:
                options.append(row[d - 1])
            if j < len(words) and words[j] == wanted:
                m, _, _, first = before[d]
                first = first if m else j
                options.append((m + 1, first - j, -abs(first - band), first))
            row.append(max(options))
        before = row + [none]
    matched, span, _, first = max(before)
    return matched, first, first - span


def most_matched(bag, words):
    """Words of a template that a window can match at most, in whatever order: a bound that costs no alignment."""
    kinds, counts = bag
    at = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    return int(np.minimum(np.bincount(at[kinds[at] == words], minlength=len(kinds)), counts).sum())


def scan_words(hashes, index, coverage):
    """(template, matched, first word, last word) of every place where a template is covered well enough."""
    at, found = winnow(hashes)
    if not len(at):
        return []
    prints = found[at]
    near = index.maybe[prints & np.uint64(0xFFFF)]
    tried = {}
    for i, value in zip(at[near].tolist(), prints[near].tolist()):
        for t, j in index.places.get(value, ()):
            tried.setdefault((t, (i - j) // BAND), i - j)
    out = []
    for (t, _), diagonal in sorted(tried.items()):
        template = index.words[t]
        start = max(0, diagonal - BAND)
        lead = BAND - (diagonal - start)
        inside = hashes[start:diagonal + len(template) + BAND]
        if most_matched(index.bags[t], inside) < coverage * len(template):
            continue
        window = [None] * lead + inside.tolist()
        matched, first, last = align(template.tolist(), window)
        if matched >= coverage * len(template):
            out.append((t, matched, start + first - lead, start + last - lead))
    best, kept = [], {}  # kept: starts and ends of a template's spans in order; they are apart, so one of them settles a hit
    for hit in sorted(out, key=lambda x: (x[0], -x[1], x[3] - x[2], x[2])):
        starts, ends = kept.setdefault(hit[0], ([], []))
        at = bisect_right(starts, hit[3])
        if not at or ends[at - 1] < hit[2]:
            starts.insert(at, hit[2])
            ends.insert(at, hit[3])
            best.append(hit)
    return sorted(best, key=lambda x: (x[2], x[0]))


def scan_licenses(documents, templates=None, coverage=0.8, doc_id="doc_id", text="text"):
    """One row per found wording: doc_id, license, coverage, matched, template_words, start, end.

    Words are runs of ASCII letters, digits and letters of other scripts, A-Z lower-cased; coverage is the share of the
    template's words found in order within the band; start and end are code points of the original text, end exclusive.
    Of overlapping finds of one template the best stays. Whole texts are read. Null and empty texts, and an empty
    table, give no rows; a null id stays null; repeated rows give repeated finds; other columns are not looked at.
    """
    index = Index(templates or TEMPLATES)
    kind = documents.schema[doc_id].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for offset, texts in pieces(batch.column(1)):
                hashes, first = word_hashes(texts, separators=PUNCTUATION)
                if not len(hashes):
                    continue
                everywhere = grams(hashes, K)
                places = np.flatnonzero(index.maybe[everywhere & np.uint64(0xFFFF)])
                places = places[np.isin(everywhere[places], index.known)]
                for d in np.unique(np.searchsorted(first, places, side="right") - 1).tolist():
                    finds = scan_words(hashes[first[d]:first[d + 1]], index, coverage)
                    if finds:
                        begin, end = word_spans(np.frombuffer(texts[d], dtype=np.uint8), PUNCTUATION)
                        for t, matched, a, b in finds:
                            size = len(index.words[t])
                            left = len(texts[d][:begin[a]].decode())
                            rows.append((offset + d, index.names[t], matched / size, matched, size, left, left + len(texts[d][begin[a]:end[b]].decode())))
            if rows:
                at, *columns = zip(*rows)
                kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at))] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["id", "license", "coverage", "matched", "template_words", "start", "end"])

    found = documents.select(documents[doc_id].alias("id"), documents[text].alias("body")).mapInArrow(scan, f"id {kind}, {SCHEMA}")
    return found.withColumnRenamed("id", doc_id)
