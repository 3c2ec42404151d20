"""License scans by exact set-similarity join.

Blocks are lines, cut into overlapping runs of RUN words where they are longer, and runs over the whole text, across lines, so that a
wrapped or long notice is one block. The length of a text-wide run depends on the template: the smallest power of two (LEAST_RUN or
more) that holds twice the template's words; runs step by half of themselves, so any stretch as long as the template lies inside one,
and a short template is not put together from words that are far apart.
A block meets a template when the share of the template's different words that it holds is at least the threshold. Words are
ordered by their count in all documents, rarest first (words of no template come
after all others: any order is exact, this one is short). Three filters leave few
pairs to verify: a block must share one of a template's first |T| - need + 1 words
(prefix), hold at least ``need`` different words (length), and have enough words
left after the shared place (position). No pair above the threshold is missed.

The template list is bounded (MAX_WORDS words in all) and broadcast. Base
phrases are found word by word in the same pass.

Nulls: a null text has no words. Repeated rows: one result each. Empty table: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, table, words

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and text of the license statements that blocks are held against.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("reserved", "All rights reserved."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD, RUN, LEAST_RUN, MAX_WORDS = 0.8, 64, 16, 2_000_000


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> list[bytes]:
    return sorted({w for _, t in templates for w in words(t)} | {w for p, _ in phrases for w in words(p)})


def word_counts(docs: DataFrame, vocab: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Count of each listed word in all documents; the list is bounded, so is what comes back."""

    def run(batches):
        total = np.zeros(len(vocab) + 1, np.int64)
        at = {w: i for i, w in enumerate(vocab)}
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = words(t)
                total += np.bincount(np.fromiter((at.get(w, -1) + 1 for w in ws), np.int64, len(ws)), minlength=len(vocab) + 1)[: len(vocab) + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab)), pa.int32()), pa.array(total[1:])], ["w", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {vocab[r["w"]]: r["n"] for r in rows}


class Matcher:
    """Templates in frequency order with their prefix index."""

    def __init__(self, templates, phrases, counts: dict[bytes, int], threshold: float):
        if sum(len(words(t)) for _, t in templates) > MAX_WORDS:
            raise ValueError(f"at most {MAX_WORDS} words of templates")
        vocab = vocabulary(templates, phrases)
        order = sorted(vocab, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates, self.prefix = [], {}
        runs: dict[int, dict] = {}
        for label, text in templates:
            t = sorted({self.rank[w] for w in words(text)})
            need = max(1, -(-len(t) * round(threshold * 1000) // 1000))
            k = len(self.templates)
            self.templates.append((label, frozenset(t), t, need))
            run = max(LEAST_RUN, 1 << (2 * len(words(text)) - 1).bit_length())
            for i, r in enumerate(t[: len(t) - need + 1]):
                self.prefix.setdefault(r, []).append((k, i))
                runs.setdefault(run, {}).setdefault(r, []).append((k, i))
        mark = lambda prefix: np.isin(np.arange(len(order) + 1), list(prefix))
        self.first = mark(self.prefix)
        #: (run length, words of the prefixes of its templates, these prefixes)
        self.runs = [(run, mark(prefix), prefix) for run, prefix in sorted(runs.items())]
        self.phrases = [(np.array([self.rank[w] for w in words(p)], np.int64), label) for p, label in phrases]

    def block(self, ranks: np.ndarray, prefix: dict | None = None) -> list[tuple[int, float]]:
        """(template, containment) of every template (of the prefixes) that a block of words meets; unknown words have rank -1."""
        prefix = self.prefix if prefix is None else prefix
        have = np.unique(ranks)
        known = have[have >= 0].tolist()
        # unknown words come last in the order; only their number matters
        size = len(known) + int((ranks < 0).sum())
        found, seen = [], set()
        for j, r in enumerate(known):
            for k, i in prefix.get(r, ()):
                if k in seen:
                    continue
                label, members, t, need = self.templates[k]
                if size < need or 1 + min(len(t) - i - 1, size - j - 1) < need:
                    continue
                seen.add(k)
                both = sum(x in members for x in known)
                if both >= need:
                    found.append((k, both / len(t)))
        return found


def scan_text(text: str | None, m: Matcher) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, float]]]:
    """(n_words, base places (first word, label), matches (template, lo, hi, containment)) of one text."""
    if not text:
        return 0, [], []
    lines = [x.split() for x in text.encode("utf-8", "surrogatepass").translate(_LINES).split(b"\n")]
    n = sum(map(len, lines))
    get = m.rank.get
    ranks = np.fromiter((get(w, -1) for ws in lines for w in ws), np.int64, n)
    base: list[tuple[int, str]] = []
    for p, label in m.phrases:
        if n >= len(p):
            ok = ranks[: n - len(p) + 1] == p[0]
            for k in range(1, len(p)):
                ok &= ranks[k : n - len(p) + 1 + k] == p[k]
            base += [(int(x), label) for x in np.flatnonzero(ok)]
    matches = []
    hot = np.flatnonzero(m.first[ranks])
    if len(hot):
        ends = np.cumsum([len(x) for x in lines])
        done = set()
        for line in np.unique(np.searchsorted(ends, hot, "right")).tolist():
            lo, hi = int(ends[line]) - len(lines[line]), int(ends[line])
            for a in range(lo, max(lo + 1, hi - RUN // 2), RUN // 2):
                b = min(a + RUN, hi)
                for k, share in m.block(ranks[a:b]):
                    if (k, line, share) not in done:
                        done.add((k, line, share))
                        matches.append((k, a, b, share))
        # across lines: runs with a hot word; a notice that is there already is not named again
        for run, first, prefix in m.runs:
            at = np.flatnonzero(first[ranks]) // (run // 2)
            last = max(0, -(-n // (run // 2)) - 2)
            for i in np.unique(np.clip(np.r_[at, at - 1], 0, last)).tolist():
                a, b = i * (run // 2), min(i * (run // 2) + run, n)
                for k, share in m.block(ranks[a:b], prefix):
                    if not any(k == j and lo < b and hi > a and s >= share for j, lo, hi, s in matches):
                        matches.append((k, a, b, share))
    return n, base, matches


_LINES = bytes(10 if i == 10 else b for i, b in enumerate(WORD_TABLE))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, places array<struct<word,label>>, matches array<struct<label,template,lo,hi,containment>>) for every row."""
    counts = word_counts(docs, vocabulary(templates, phrases), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, phrases, counts, threshold))  # at most MAX_WORDS words
    kind = docs.schema[id_col].dataType.simpleString()
    places_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    matches_t = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        matcher = shared.value
        for b in batches:
            n, places, matches = [], [], []
            for t in b.column(1).to_pylist():
                k, base, found = scan_text(t, matcher)
                n.append(k)
                places.append([{"word": w, "label": x} for w, x in base])
                matches.append([{"label": matcher.templates[i][0], "template": i, "lo": lo, "hi": hi, "containment": c} for i, lo, hi, c in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, places_t), pa.array(matches, matches_t)], ["id", "n_words", "places", "matches"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, matches array<struct<label:string,template:int,lo:bigint,hi:bigint,containment:double>>")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return s.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        join(F.col("places.label")).alias("base_labels"), join(F.concat("places.label", "matches.label")).alias("labels"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("score"),
    )
