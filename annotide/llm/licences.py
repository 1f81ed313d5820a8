"""Licence scans by a positional rare-token index.

Every template has mandatory phrases, and each phrase is indexed by its rarest
word: a posting says in which template and phrase, and at which place of it, the
word stands.  A file's words are looked up; of those that a template needs, the
file's rarest one proposes places, and the postings of the others are
intersected with them by relative position (within a slack).  A candidate counts
only if all mandatory phrases of the template stand there, so a text in which
they all stand where the template has them is never lost.

Rarity is the inverse document frequency of a template word over the whole
corpus, so a licence word that is common in some language (mit) proposes
nothing where a rarer one is needed too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotide.llm.common import Lookup, append_columns, by_bytes, hash_words, joined_words, quoted

# Phrases that are licence names, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Licence templates (label, text, mandatory phrases).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "following conditions are met"],
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["used to endorse or promote products derived from this software", "specific prior written permission"],
    ),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication no copyright", ["cc0 1 0 universal"]),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["under the terms of the gnu general public license", "published by the free software foundation"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee", "hereby granted"],
    ),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "without restriction including without limitation"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

#: How many words a mandatory phrase may be off its place in a template, beside those outside the phrases that may be missing.
SLACK = 8

MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("is_phrase", T.BooleanType()),
        ]
    ),
    containsNull=False,
)
_MATCHES_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("is_phrase", pa.bool_())])
)


@dataclass
class Template:
    """``keys`` are the mandatory phrases, ``offsets`` their places in the template, ``lead`` the one with the rarest word."""

    label: str
    size: int
    keys: list[np.ndarray]
    offsets: list[int]
    lead: int
    is_phrase: bool
    weight: dict[int, float]


@dataclass
class Index:
    """Postings of the phrases' rarest words: ``postings[w]`` lists (template, phrase, place in the phrase)."""

    known: Lookup
    templates: list[Template]
    postings: dict[int, list[tuple[int, int, int]]]
    anchor: np.ndarray


def vocabulary() -> tuple[Lookup, dict[str, int]]:
    """All template words, and each one's number."""
    words = sorted({w for text in [*PHRASES, *(t for _, t, _ in TEMPLATES)] for w in text.split()})
    hashes = hash_words(words)
    known = Lookup(hashes)
    return known, dict(zip(words, known.ids(hashes).tolist(), strict=True))


def build_index(counts: dict[int, int], rows: int) -> Index:
    """Index the templates; ``counts`` has the documents that hold each word number."""
    known, number = vocabulary()
    rarity = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in number.values()}
    templates, postings = [], {}
    wanted = [(label, text, [text], True) for text, label in PHRASES.items()] + [(label, text, keys, False) for label, text, keys in TEMPLATES]
    for k, (label, text, keys, is_phrase) in enumerate(wanted):
        words = [number[w] for w in text.split()]
        phrases = [[number[w] for w in key.split()] for key in keys]
        offsets = [next(a for a in range(len(words)) if words[a : a + len(p)] == p) for p in phrases]
        rarest = [max(range(len(p)), key=lambda a, p=p: (rarity[p[a]], -a)) for p in phrases]
        lead = max(range(len(phrases)), key=lambda i: (rarity[phrases[i][rarest[i]]], -i))
        templates.append(Template(label, len(words), [np.array(p, np.int64) for p in phrases], offsets, lead, is_phrase, {w: rarity[w] for w in set(words)}))
        for i, at in enumerate(rarest):
            postings.setdefault(phrases[i][at], []).append((k, i, at))
    anchor = np.zeros(len(known.hashes) + 1, bool)  # the last entry is for strangers
    anchor[list(postings)] = True
    return Index(known, templates, postings, anchor)


def _stands(ids: np.ndarray, begins: np.ndarray, places: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Those of ``places`` (in order) where ``phrase`` stands within one text."""
    places = places[(places >= 0) & (places + len(phrase) <= len(ids))]
    places = places[np.searchsorted(begins, places, "right") == np.searchsorted(begins, places + len(phrase) - 1, "right")]
    for i, w in enumerate(phrase.tolist()):
        places = places[ids[places + i] == w]
    return places


def scan(index: Index, texts: Sequence[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each text, and the templates that stand in it."""
    hashes, begins = joined_words([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    found: list[list[dict]] = [[] for _ in texts]
    ids = index.known.ids(hashes)
    hits = np.flatnonzero(index.anchor[ids])
    stands: dict[tuple[int, int], np.ndarray] = {}
    words = ids[hits]
    for w, posted in index.postings.items():
        own = hits[words == w]
        if len(own):
            for k, i, at in posted:
                stands[k, i] = _stands(ids, begins, own - at, index.templates[k].keys[i])
    for k, t in enumerate(index.templates):
        places = stands.get((k, t.lead), np.zeros(0, np.int64))
        if not len(places):
            continue
        row = np.searchsorted(begins, places, "right") - 1
        first, last = places.copy(), places + len(t.keys[t.lead])
        good = np.ones(len(places), bool)
        for i, phrase in enumerate(t.keys):
            if i == t.lead:
                continue
            others = stands.get((k, i), np.zeros(0, np.int64))
            if not len(others):
                good[:] = False
                break
            wanted = places + t.offsets[i] - t.offsets[t.lead]
            slack = SLACK + max(0, t.size - sum(map(len, t.keys)))
            nearest, gap = np.zeros(len(places), np.int64), np.full(len(places), slack + 1)
            right = np.searchsorted(others, np.clip(wanted, begins[row], begins[row + 1] - 1))  # neighbours in the same text
            for side in (right - 1, right):
                at = others[np.clip(side, 0, len(others) - 1)]
                off = np.where((at >= begins[row]) & (at < begins[row + 1]), np.abs(at - wanted), slack + 1)
                nearest, gap = np.where(off < gap, at, nearest), np.minimum(gap, off)
            good &= gap <= slack
            nearest = np.where(gap <= slack, nearest, places)
            first, last = np.minimum(first, nearest), np.maximum(last, nearest + len(phrase))
        met = sorted(set(zip(row[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True)))
        for r, a, b in met:
            score = 1.0
            if not t.is_phrase:
                there = set(ids[max(int(begins[r]), a - t.size - SLACK) : min(int(begins[r + 1]), b + t.size + SLACK)].tolist())
                score = min(1.0, sum(v for w, v in t.weight.items() if w in there) / sum(t.weight.values()))
            found[r].append({"label": t.label, "start_word": a - int(begins[r]), "end_word": b - int(begins[r]), "score": score, "is_phrase": t.is_phrase})
    for own in found:
        own.sort(key=lambda m: (m["start_word"], m["label"], m["end_word"]))
    return np.diff(begins), found


def word_documents(documents: DataFrame, text: str = "text") -> tuple[dict[int, int], int]:
    """Documents that hold each template word, and documents in all; one row a word reaches the driver."""
    known, _ = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(known.hashes)
        counts, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in by_bytes(batch, "text", 2 << 20):
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in part.column("text").to_pylist()]
                hashes, begins = joined_words(texts)
                ids = known.ids(hashes)
                at = np.flatnonzero(ids >= 0)
                row = np.searchsorted(begins, at, side="right") - 1
                held = np.unique(row * size + ids[at])
                counts += np.bincount(held % size, minlength=size)
                rows += part.num_rows
        words = [-1, *range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array([rows, *counts.tolist()], pa.int64())], names=["word", "n"])

    got = documents.select(quoted(text).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in got}
    return counts, counts.pop(-1, 0)


def with_licences(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with n_words and licences, the places where licences stand.

    A-Z are lower-cased; a word is a run of ASCII letters or digits and of
    characters outside ASCII.  A null or empty text has no words and no
    licence.  Every place of a phrase is reported, and of a template every place
    of its rarest mandatory phrase with the nearest ones of the others, ordered
    by word.  Columns named n_words or licences are replaced.
    """
    counts, rows = word_documents(documents, text)
    index = build_index(counts, rows)

    def kernel(texts: list[str]) -> list[pa.Array]:
        words, found = scan(index, texts)
        return [pa.array(words, pa.int64()), pa.array(found, _MATCHES_ARROW)]

    return append_columns(documents, text, [T.StructField("n_words", T.LongType()), T.StructField("licences", MATCHES)], kernel)
