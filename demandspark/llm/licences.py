"""License scans over a positional rare-token index.

The index holds, for each word of the licence templates, the templates and the places where it stands in them. A file's
licence words are looked up from rare to frequent, by an IDF measured over the whole corpus. Each occurrence in the file
and each place in a template give a relative position; where several different words agree on it, and only there, the
template's mandatory key phrases are verified at their places. Base phrases of the contract are sought from the rarest
word of each, so that every place is counted.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import batch_of, column, read_table, texts

#: Bytes that part words once A-Z are lower-cased: everything in ASCII but digits and letters.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_SPACE = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


@dataclass(frozen=True)
class Template:
    """A licence text and the phrases that it cannot lack."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Base phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The usual notices of public licences.
TEMPLATES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit-notice", "Released under the MIT License. This project is licensed under the terms of the MIT license", ("under the mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", ("under the apache license version 2 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("general public license version 2",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", ("terms of the gnu general public license", "published by the free software foundation")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("terms of the mozilla public license v 2 0",)),
    Template("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("to endorse or promote products derived from this software without specific prior written permission",)),
    Template("mit-whole", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("permission is hereby granted free of charge", "shall be included in all copies or substantial portions of the software")),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission is granted to anyone to use this software for any purpose including commercial applications",)),
    Template("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ("use reproduce display distribute execute and transmit the software",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
)


def read_templates(folder: str | Path, key_words: int = 8) -> tuple[Template, ...]:
    """Whole licence texts, a file each, labelled by file name; the first words (the title) are the mandatory phrase."""
    files = sorted(f for f in Path(folder).iterdir() if f.is_file())
    texts_ = [(f.name.lower(), f.read_text(errors="replace")) for f in files]
    titles = [b" ".join(words_of(text.encode())[:key_words]).decode() for _, text in texts_]
    return tuple(Template(n, text, (title,)) for (n, text), title in zip(texts_, titles, strict=True) if title)


class Index:
    """Postings of licence words over all templates, with the IDF of the words.

    A template can only stand where its key phrase (the mandatory one of the highest IDF) does, whose words then agree
    on one position whatever else the file holds. Looking words up in IDF order until ``agree`` of the key phrase and
    ``n_rare`` of the template are among them thus finds every place: no other words can crowd a template out.
    """

    def __init__(self, base: dict[str, str], templates: tuple[Template, ...], df: dict[bytes, int], n_docs: int,
                 n_rare: int = 12, agree: int = 3, slack: int = 8):
        self.base, self.n_rare, self.slack = {p: (label, words_of(p.encode())) for p, label in base.items()}, n_rare, slack
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in vocabulary(base, templates)}
        self.labels = [t.label for t in templates]
        #: Each word's templates, with its places in them.
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.weight: list[float] = []
        #: Of each template, the words of its mandatory phrases and of the key phrase, and the phrases with their places
        #: and rarest words.
        self.needed: list[set[bytes]] = []
        self.key: list[set[bytes]] = []
        self.mandatory: list[list[tuple[list[bytes], int, int]]] = []
        for t, template in enumerate(templates):
            ws = words_of(template.text.encode())
            for i, w in enumerate(ws):
                self.postings[w][t].append(i)
            self.weight.append(sum(self.idf[w] for w in sorted(set(ws))))
            phrases = [words_of(m.encode()) for m in template.mandatory]
            self.mandatory.append([(p, place(ws, p), self.rarest(p)) for p in phrases])
            self.needed.append({w for p in phrases for w in p})
            self.key.append(max((set(p) for p in phrases), key=lambda ws: sum(self.idf[w] for w in sorted(ws))))
        #: How many different words have to agree on a position.
        self.votes = [min(agree, len(key)) for key in self.key]
        self.postings = {w: dict(own) for w, own in self.postings.items()}

    def rarest(self, phrase: list[bytes]) -> int:
        return max(range(len(phrase)), key=lambda i: (self.idf[phrase[i]], -i))

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, float]:
        words = words_of(text)
        at: dict[bytes, list[int]] = defaultdict(list)
        idf = self.idf
        for i, w in enumerate(words):
            if w in idf:
                at[w].append(i)
        starts, labels = [], set()
        for label, phrase in self.base.values():
            if found := list(stands(words, at, phrase, self.rarest(phrase), 0, len(words))):
                starts += found
                labels.add(label)
        base_labels = ",".join(sorted(labels))
        matches = dict(self.matches(words, at)) if at else {}
        covered = max(matches.values(), default=0.0)
        score = 0.5 + 0.5 * covered if matches else 0.5 if starts else 0.0
        first, last = min(starts, default=None), max(starts, default=None)
        return len(words), len(starts), first, last, base_labels, ",".join(sorted(labels | {*matches})), score, covered

    def positions(self, at: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """Templates with the positions, in bins of ``slack`` words, that enough of the file's rarest words agree on."""
        open_ = {t: [0, 0] for t, needed in enumerate(self.needed) if needed <= at.keys()}
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w in sorted(at, key=lambda w: (-self.idf[w], w)) if open_ else ():
            for t, own in self.postings.get(w, {}).items():
                if (done := open_.get(t)) is None or (done[0] >= self.n_rare and done[1] >= self.votes[t]):
                    continue
                done[0] += 1
                done[1] += w in self.key[t]
                # Neighbouring bins overlap, so that words a few places apart can agree across a border.
                for bin_ in {(pos - i) // self.slack for pos in at[w] for i in own}:
                    votes[t, bin_].add(w)
                    votes[t, bin_ + 1].add(w)
        return (place_ for place_, ws in votes.items() if len(ws) >= self.votes[place_[0]])

    def matches(self, words: list[bytes], at: dict[bytes, list[int]]) -> Iterator[tuple[str, float]]:
        """Labels of the templates whose key phrases stand at such a position, with the IDF share of the words there."""
        best: dict[int, float] = {}
        for t, bin_ in self.positions(at):
            low, high = (bin_ - 2) * self.slack, (bin_ + 2) * self.slack
            if all(any(s >= 0 for s in stands(words, at, p, r, low + i, high + i)) for p, i, r in self.mandatory[t]):
                found = (self.idf[w] for w in sorted(at) if near(at[w], self.postings.get(w, {}).get(t, ()), low, high))
                best[t] = max(best.get(t, 0.0), min(sum(found) / (self.weight[t] or 1.0), 1.0))
        return ((self.labels[t], share) for t, share in best.items())


def stands(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes], rarest: int, low: int, high: int) -> Iterator[int]:
    """Starts of a phrase from ``low`` to before ``high``, found from the places of its rarest word."""
    places = at.get(phrase[rarest], ())
    for k in range(bisect_left(places, low + rarest), len(places)):
        start = places[k] - rarest
        if start >= high:
            return
        if start >= 0 and words[start : start + len(phrase)] == phrase:
            yield start


def near(at: list[int], own: list[int], low: int, high: int) -> bool:
    """Whether one of the sorted places ``at`` is ``low`` to ``high`` after one of a template's."""
    return any((k := bisect_left(at, low + i)) < len(at) and at[k] < high + i for i in own)


def place(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def vocabulary(base: dict[str, str], templates: tuple[Template, ...]) -> set[bytes]:
    return {w for t in [*base, *(t.text for t in templates)] for w in words_of(t.encode())}


def document_frequencies(docs: DataFrame, vocab: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all of them: one row per word of the vocabulary."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for t in texts(batch):
                counts.update(vocab.intersection(words_of(t)))
                counts[b""] += 1
        yield batch_of(schema, list(counts), list(counts.values()))

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.word): r.n for r in rows}
    return df, df.pop(b"", 0)


def scan_licences(
    docs: DataFrame, base: dict[str, str] | None = None, templates: tuple[Template, ...] = TEMPLATES, **tuning
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, covered)``, one row per
    row of ``docs``.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any). ``labels`` adds those of matched templates. ``score`` is 0 without a label, 0.5 for a phrase
    alone, and up to 1 by ``covered``, the largest IDF share of a matched template that stands at its place. Null and empty texts have no
    words; repeated rows are scanned alike; other columns are ignored.
    """
    base = BASE_PHRASES if base is None else base
    df, n_docs = document_frequencies(docs, vocabulary(base, templates))
    index = docs.sparkSession.sparkContext.broadcast(Index(base, templates, df, n_docs, **tuning))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
         ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("covered", pa.float64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = index.value.scan
        for batch in batches:
            cols = list(zip(*map(scan, texts(batch)), strict=True)) or [[]] * 8
            yield batch_of(schema, column(batch, "doc_id"), *cols)

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, covered double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents"))
