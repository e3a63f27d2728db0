"""Licence scan by a positional index of rare template words.

Every licence template is a list of words with postings ``word -> (template, position)``. How rare a licence
word is comes from all documents: its inverse document frequency. A template has mandatory key phrases, so the
rarest word of its phrases is in every match: that word is looked up in the document, and each of its places at
which its phrase stands proposes the starts of the template around it. The postings of the template's words must
then agree with a start by their relative positions, and all key phrases must stand where the start puts them.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased, counted from 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import map_batches, slices, text_of

#: Bytes to themselves, to lower case, or to the space that separates words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    """A licence text or notice. ``keys`` are its mandatory phrases; a base template is one whole phrase."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases and notices as the licences themselves word them.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
             "software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a "
             "copy of the License at", ("except in compliance with the license",)),
    Template("gpl-notice", "is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl", "GNU Affero General Public License", ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted", ("permission to use copy modify",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License",
             ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("released into the public domain",)),
    Template("cc-by-nc", "Licensed under CC BY-NC", ("cc by nc",)),
    Template("cc-by", "licensed under a Creative Commons Attribution", ("creative commons attribution",)),
)
#: Least share of template words in place, drift of words and phrases from their places.
COVERAGE, DRIFT = 0.8, 2


class Index:
    """Postings of the template words with their rarity."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates, self.idf = templates, idf
        self.words = [words_of(t.text) for t in templates]
        self.keys: list[list[tuple[int, list[bytes]]]] = []  # by template, its key phrases and their positions in it
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for p, word in enumerate(words):
                self.postings.setdefault(word, []).append((t, p))
            self.keys.append([(self._position(t, key), key) for key in map(words_of, templates[t].keys)])
        self.vocabulary = set(self.postings)
        # The rarest word of all key phrases: the phrase, where the word stands in it, and the word.
        self.anchors = [
            min(((k, i, w) for k, (_, key) in enumerate(keys) for i, w in enumerate(key)), key=lambda a: (-idf.get(a[2], 0.0), a))
            for keys in self.keys
        ]

    def _position(self, t: int, key: list[bytes]) -> int:
        """Where a phrase stands in its template, by the postings of its words."""
        starts = set.intersection(*({p - i for u, p in self.postings[w] if u == t} for i, w in enumerate(key)))
        return min(starts)

    def find(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """Verified starts by template, each with the share of template words found in place."""
        present = self.vocabulary.intersection(words)
        places: dict[bytes, list[int]] = {}
        found = {}
        for t, (k, i, word) in enumerate(self.anchors):
            if not present.issuperset(w for _, key in self.keys[t] for w in key):
                continue
            if word not in places:
                places[word] = _places(words, word)
            position, key = self.keys[t][k]
            stands = [at - i for at in places[word] if at >= i and words[at - i : at - i + len(key)] == key]
            if stands and (own := self._verify(t, stands, position, words)):
                found[t] = own
        return found

    def _verify(self, t: int, stands: list[int], position: int, words: list[bytes]) -> dict[int, float]:
        """Starts of template ``t`` around the places of one of its phrases, which has ``position`` in it."""
        template, n = self.words[t], len(words)
        if self.templates[t].base:  # the phrase is the whole template
            return dict.fromkeys(stands, 1.0)
        found = {}
        for start in sorted({at - position + d for at in stands for d in range(-DRIFT, DRIFT + 1)}):
            hits = 0
            for p, word in enumerate(template):
                i = start + p
                if 0 <= i < n and words[i] == word or word in words[max(0, i - DRIFT) : max(0, i + DRIFT + 1)]:
                    hits += 1
            share = hits / len(template)
            if share >= COVERAGE and all(self._stands(key, words, start + at) for at, key in self.keys[t]):
                found[max(start, 0)] = max(share, found.get(max(start, 0), 0.0))
        return found

    @staticmethod
    def _stands(key: list[bytes], words: list[bytes], at: int) -> bool:
        return any(words[i : i + len(key)] == key for i in range(max(0, at - DRIFT), max(0, at + DRIFT + 1)))


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double"
)


def word_rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of every template word over all documents.

    Counts combine in the tasks; the driver receives a number per template word.
    """
    vocabulary = {w for t in templates for w in words_of(t.text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for some in slices(batch):
                rows += some.num_rows
                for text in some.column("text").to_pylist():
                    for word in vocabulary.intersection(words_of(text)):
                        seen[word] += 1
        yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode() for w in seen)], "n": [rows, *seen.values()]})

    counted = text_of(docs).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word: r.n for r in counted.collect()}
    total = n.pop(None, 0)
    return {w.encode(): math.log((1 + total) / (1 + k)) for w, k in n.items()}


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, idf: dict[bytes, float] | None = None
) -> DataFrame:
    """One row per row of ``docs``: word count, places of base phrases, labels and score.

    ``n_base``, ``first_word`` and ``last_word`` cover all places of base phrases; ``labels`` also holds what
    else the method verified. ``score`` is the largest share of a verified template's words that stand in
    place, 1.0 for a whole phrase and 0.0 without any. Null text counts as empty, labels are then empty and
    places null. Repeated rows repeat, an empty table gives no rows, other columns are not read.
    """
    index = Index(templates, word_rarity(docs, templates) if idf is None else idf)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [] for name in (
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            found = index.find(words)
            base = [s for t, own in found.items() if index.templates[t].base for s in own]
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(base, default=None))
            out["last_word"].append(max(base, default=None))
            out["base_labels"].append(",".join(sorted({templates[t].label for t in found if templates[t].base})))
            out["labels"].append(",".join(sorted({templates[t].label for t in found})))
            out["score"].append(max((s for own in found.values() for s in own.values()), default=0.0))
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), **out}

    return map_batches(text_of(docs, "doc_id"), run, SCHEMA)
