"""License scans by a positional rare-token index.

Templates are short licence notices. The index holds, for each template, the postings (template, position) of its rarest
words, by IDF over the templates. A file is cut into words once; its licence words of highest IDF are looked up, their postings are
intersected by relative position (file position minus template position), and an alignment counts where enough of the template's rare words
agree and all its mandatory key phrases stand there. Base phrases are templates whose whole text is mandatory: their anchor is their
rarest word, so every place of the phrase is found, exactly.

The index is built from the templates alone, so it is small and fixed; the scan is one map over the files, without a shuffle.

Defined results: a null text is empty: no words, no labels, score 0; empty and very long texts are scanned whole; repeated rows give
repeated results; an empty table gives no rows; only the id and text columns are read, so clashing extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word is, in UTF-8 text lower-cased in A-Z only.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """The words of a text."""
    return _WORD.findall((text or "").translate(_LOWER))


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, key phrases that must stand in the aligned place, and the share of rare words that must agree."""

    label: str
    text: str
    required: tuple[str, ...] = ()
    share: float = 0.6


#: Base phrases, to be found everywhere, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Customary notices of public licences.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license, version 2.0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("gnu-gpl", "this work is licensed under the gnu general public license, version 3", ("gnu general public license",)),
    Template("gnu-lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by-nc 4.0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by-sa 4.0", ("cc by sa",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v 2.0", ("mozilla public license",)),
    Template("isc", "permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Rare words kept for each template.
RARE = 4


@dataclass(frozen=True)
class Entry:
    """An indexed template: its words, rare positions, required phrases as (offset, words), agreement needed."""

    label: str
    words: tuple[str, ...]
    rare: tuple[int, ...]
    required: tuple[tuple[int, tuple[str, ...]], ...]
    need: int
    base: bool


def _places(phrase: list[str], text: list[str]) -> list[int]:
    return [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


class Index:
    """Postings of rare words: word -> [(entry number, position)], and the IDF of every licence word."""

    def __init__(self, base=BASE, notices=NOTICES, rare: int = RARE) -> None:
        texts = [words(p) for p, _ in base] + [words(t.text) for t in notices]
        df = Counter(w for t in texts for w in set(t))
        self.idf = {w: math.log((1 + len(texts)) / n) for w, n in df.items()}
        by_rarity = lambda t: sorted(range(len(t)), key=lambda i: (-self.idf[t[i]], t[i], i))
        self.entries: list[Entry] = []
        for (_, label), t in zip(base, texts, strict=False):
            self.entries.append(Entry(label, tuple(t), (by_rarity(t)[0],), ((0, tuple(t)),), 1, True))
        for n, t in zip(notices, texts[len(base) :], strict=True):
            keys = [words(p) for p in n.required]
            if not keys or any(not _places(k, t) for k in keys):
                raise ValueError(f"template {n.label}: a required phrase isn't part of the text")
            kept = tuple(sorted(by_rarity(t)[:rare]))
            self.entries.append(Entry(n.label, tuple(t), kept, tuple((_places(k, t)[0], tuple(k)) for k in keys), max(1, math.ceil(n.share * len(kept))), False))
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for k, e in enumerate(self.entries):
            for i in e.rare:
                self.postings.setdefault(e.words[i], []).append((k, i))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
        found = words(text)
        hits = sorted(self.postings.keys() & set(found), key=lambda w: (-self.idf[w], w))
        votes: Counter[tuple[int, int]] = Counter()
        for w in hits:
            at = -1
            for _ in range(found.count(w)):
                at = found.index(w, at + 1)
                for k, i in self.postings[w]:
                    votes[k, at - i] += 1
        starts, base, labels, score = [], set(), set(), 0.0
        for (k, start), n in votes.items():
            e = self.entries[k]
            if n >= e.need and all(start + o >= 0 and tuple(found[start + o : start + o + len(p)]) == p for o, p in e.required):
                labels.add(e.label)
                score = max(score, n / len(e.rare))
                if e.base:
                    base.add(e.label)
                    starts.append(start)
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str | Column = "text", index: Index | None = None) -> DataFrame:
    """One row per file: its key, and what Index.scan finds in its text."""
    index = index or Index()

    def scan(batches):
        for b in batches:
            got = list(zip(*(index.scan(t.as_py()) for t in b.column(1)), strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind) for v, (_, kind) in zip(got, _FIELDS, strict=True))], [key, *(n for n, _ in _FIELDS)])

    ready = docs.select(F.col(key), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = ready.schema[key].dataType.simpleString()
    return ready.mapInArrow(scan, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
