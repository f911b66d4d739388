"""License scan by a positional rare-token index over notice templates.

The templates' words are ranked by inverse document frequency over all documents: one pass
counts in how many each of these words stands. The rarest words of each template are its
anchors, kept with their positions: as many as a notice that still counts may have lost, and
some more. A file's words are looked up in that index; every hit proposes a place where the
template would start (position of the word less the anchor's position), places that gather
as many anchors as no such notice can lack are aligned with the template word by word, and a
template counts only if its mandatory key phrases stand in the aligned window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.arrow import map_batches, utf8
from gleanworks.session import table

#: Notice templates, each with its label and the phrases it cannot go without.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0",
        ("in compliance with the license", "apache org licenses"),
    ),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation",
        ("general public license", "free software foundation"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd", "4 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", ("waived all copyright",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software",
        ("permission is hereby granted", "sublicense and or sell copies of the software"),
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may"
        " obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
        " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express"
        " or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license", "apache org licenses", "as is basis without warranties or conditions of any kind"),
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
        " the documentation and or other materials provided with the distribution",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published"
        " by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published"
        " by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as"
        " published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("lesser general public license", "version 2 1 of the license"),
    ),
    (
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as"
        " published by the free software foundation either version 3 of the license or at your option any later version",
        ("affero general public license", "version 3 of the license"),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this"
        " file you can obtain one at https mozilla org mpl 2 0",
        ("mozilla public license", "mozilla org mpl"),
    ),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
        " above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted", "appear in all copies"),
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and"
        " redistribute it freely subject to the following restrictions",
        ("alter it and redistribute it freely",),
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means",
        ("source code form or as a compiled binary",),
    ),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0",)),
)
#: Phrases of the base scan and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: A template counts from this share of its words, in order, in the window.
LEAST_SHARE = 0.7
#: How many anchors must agree on a place: one for every ten words of a template, two at least.
LEAST_ANCHORS, WORDS_AN_ANCHOR = 2, 10
#: Words that an insertion or a loss may shift an anchor by.
SLACK = 3

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(c if c in _WORD_BYTES else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and all non-ASCII bytes."""
    return text.translate(_FOLD).split()


class PositionalIndex:
    """Anchors of the templates by word, with their positions.

    ``counts`` tells in how many of ``documents`` a word stands; the rarest ones are anchors,
    among equals those in the fewest templates. A notice that has ``LEAST_SHARE`` of a template
    lacks at most ``lost`` of its words, so of ``lost + needed`` anchors it has ``needed``.
    """

    def __init__(self, templates=TEMPLATES, counts: Mapping[bytes, int] | None = None, documents: int = 0):
        self.templates = [(label, body.encode().split(), [p.encode().split() for p in keys]) for label, body, keys in templates]
        shared = Counter(w for _, body, _ in self.templates for w in set(body))
        idf = {w: math.log((1 + documents) / (1 + (counts or {}).get(w, 0))) for w in shared}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        for k, (_, body, _) in enumerate(self.templates):
            order = sorted(range(len(body)), key=lambda i: (-idf[body[i]], shared[body[i]], i))
            lost = len(body) - math.ceil(LEAST_SHARE * len(body))
            self.needed.append(min(max(LEAST_ANCHORS, len(body) // WORDS_AN_ANCHOR), len(body) - lost))
            for i in order[: lost + self.needed[-1]]:
                self.postings.setdefault(body[i], []).append((k, i))
        self.words = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template found) for each notice, in order.

        Where notices of one label overlap, the longest stays.
        """
        if self.words.isdisjoint(words):
            return []
        places: dict[tuple[int, int], set[int]] = {}
        for at, word in enumerate(words):
            for k, i in self.postings.get(word, ()):
                places.setdefault((k, at - i), set()).add(i)
        found: dict[tuple[int, int], tuple[str, int, int, float]] = {}
        for (k, start) in sorted(places):
            votes = set().union(*(places.get((k, start + d), ()) for d in range(SLACK + 1)))
            if len(votes) < self.needed[k]:
                continue
            label, body, keys = self.templates[k]
            low, high = max(0, start - SLACK), start + len(body) + 2 * SLACK
            whole = words[start : start + len(body)] == body if start >= 0 else False
            hit = list(range(start - low, start - low + len(body))) if whole else _align(body, words[low:high])
            if len(hit) < LEAST_SHARE * len(body):
                continue
            first, last = low + hit[0], low + hit[-1]
            window = words[first : last + 1]
            if all(_count(window, key) for key in keys):
                share = len(hit) / len(body)
                best = found.get((k, first))
                if best is None or share > best[3]:
                    found[k, first] = (label, first, last, share)
        return _apart(found.values())


def _apart(found: Iterable[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    taken: dict[str, set[int]] = {}
    kept = []
    for one in sorted(found, key=lambda n: (n[1] - n[2], -n[3], n[1], n[0])):  # the longest first: a later one that overlaps has an end inside
        label, first, last, _ = one
        own = taken.setdefault(label, set())
        if first not in own and last not in own:
            own.update(range(first, last + 1))
            kept.append(one)
    return sorted(kept, key=lambda n: (n[1], n[2], n[0]))


def _align(body: list[bytes], window: list[bytes]) -> list[int]:
    """Places in ``window`` of a longest common subsequence with ``body``."""
    n, m = len(body), len(window)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if body[i] == window[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    hit = []
    while i < n and j < m:
        if body[i] == window[j]:
            hit.append(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return hit


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    at, n, found = -1, len(phrase), []
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                found.append(at)
    except ValueError:
        return found


def _count(words: list[bytes], phrase: list[bytes]) -> int:
    return len(_places(words, phrase))


_BASE = [(phrase.encode().split(), label) for phrase, label in BASE_PHRASES]
_BASE_FIRST = frozenset(phrase[0] for phrase, _ in _BASE)
_INDEX = PositionalIndex()

NOTICES = "array<struct<label:string,first_word:bigint,last_word:bigint,share:double>>"
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
    f" base_labels string, labels string, score double, notices {NOTICES}"
)


def scan_text(text: bytes, index: PositionalIndex = _INDEX):
    """(words, base places with labels, notices) of one whole text."""
    words = words_of(text)
    base = []
    if not _BASE_FIRST.isdisjoint(words):
        base = [(at, label) for phrase, label in _BASE for at in _places(words, phrase)]
    return words, base, index.scan(words)


def index_of(docs: DataFrame, templates=TEMPLATES) -> PositionalIndex:
    """The templates' index with word frequencies over all of ``docs``.

    Only the templates' own words are counted: a few hundred sums reach the driver, however
    many documents there are. Without documents all words are equally rare.
    """
    known = frozenset(w for _, body, _ in templates for w in body.encode().split())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter()
        for text in utf8(batch.column(0)):
            seen.update(known.intersection(words_of(text or b"")))
        return pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), batch.num_rows], pa.int64())], ["word", "n"])

    counted = map_batches(docs.select(docs["text"].cast("string")), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in counted.collect()}
    return PositionalIndex(templates, counts, counts.pop(b"", 0))


def scan_licenses(docs: DataFrame, index: PositionalIndex | None = None) -> DataFrame:
    """A row per document: its notices, base phrases and labels, by ``index_of(docs)`` or a given index.

    A null or empty text has no words and no labels, with null places and score 0. Repeated
    rows give a row each; an empty table an empty result; other columns are ignored. ``score``
    is the largest share of a template found, and 1 where a base phrase stands.
    """
    index = index or index_of(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words, base, notices = scan_text(text or b"", index)
            labels = sorted({label for _, label in base})
            rows.append(
                {
                    "doc_id": doc_id,
                    "n_words": len(words),
                    "n_base": len(base),
                    "first_word": min((at for at, _ in base), default=None),
                    "last_word": max((at for at, _ in base), default=None),
                    "base_labels": ",".join(labels),
                    "labels": ",".join(sorted({*labels, *(n[0] for n in notices)})),
                    "score": 1.0 if base else max((n[3] for n in notices), default=0.0),
                    "notices": [dict(zip(("label", "first_word", "last_word", "share"), n, strict=True)) for n in notices],
                }
            )
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))),
    ]
)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Notices and base phrases of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("notices")
