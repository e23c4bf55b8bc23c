"""License scan: exact set-similarity join of license templates and text blocks (operator 12).

A template's containment in a block is the share of its distinct words that the block
holds.  Blocks are windows of words: a template of w words is sought in windows of 2 s
words that begin at every multiple of s, s being the least power of two not below w (8
at least), so every passage of up to s + 1 words lies whole within some window, line
breaks or not.  Words of all templates are put in one global order, by the number of
documents of the whole table that hold them, rarest first.  Then, for a template of n
words of which k must be in a block,

* prefix filter: a block is a candidate only if it holds one of the n - k + 1 rarest;
* length filter: it holds at least k words of the templates;
* positional filter: the words after the first common one suffice on both sides;

and candidates are verified word by word, so the join is exact for any order.  Phrases
(``exact`` templates) must hold all words, and stand in them one after the other.

Templates are a parameter of the driver, as patterns would be, and their index goes to
the tasks; documents, blocks and candidates stay in the tasks.  The scan shuffles
nothing; the frequencies are one row a template word and task.

Defined results: a null text has no words; a text without words or templates has no
places, no labels and score 0; repeated rows are judged each; other columns pass through
(columns called like the results are replaced); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import as_bytes, slices

#: Characters of words (0-9, a-z and all beyond ASCII) to themselves, A-Z to a-z, others to a space.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
LEAST_STRIDE = 8


@dataclass(frozen=True)
class Template:
    """Words of a notice.  ``must`` and ``never``: words that a block has to hold, or must not, to tell licenses of one family apart."""

    label: str
    text: str
    least: float = 0.8
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    exact: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(w.decode() for w in split_words(self.text.encode()))

    @property
    def needed(self) -> int:
        """How many of its distinct words a block must hold."""
        n = len(set(self.words))
        return n if self.exact else max(1, int(np.ceil(n * self.least - 1e-9)))

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, 1 << (len(self.words) - 1).bit_length())


#: Phrases of the contract: fixed values.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
#: Openings and grants of public licenses, as their publishers word them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license", must=("mit", "license")),
    Template("apache-2", "licensed under the apache license version 2 0", must=("apache", "2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", must=("gnu", "general", "3"), never=("lesser", "library", "affero")),
    Template("gpl-2", "licensed under the gnu general public license version 2", must=("gnu", "general", "2"), never=("lesser", "library", "affero", "3")),
    Template("lgpl", "licensed under the gnu lesser general public license", must=("gnu", "lesser")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", must=("gnu", "affero")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", must=("mozilla",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", must=("fee",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", must=("creative", "commons"), never=("noncommercial", "sharealike", "noderivatives")),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", must=("creative", "commons", "sharealike"), never=("noncommercial",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", must=("creative", "commons", "noncommercial")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", must=("cc", "by", "nc")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", must=("cc", "by", "sa")),
    Template("cc-by", "licensed under cc by 4 0", must=("cc", "by", "4"), never=("nc", "sa", "nd")),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", must=("waived", "neighboring")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", must=("unencumbered",)),
)
TEMPLATES = PHRASES + NOTICES
RESULT = "n_words long, matches array<struct<template:int,label:string,first_word:long,end_word:long,containment:double>>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in (*t.words, *t.must, *t.never)})


class Hits:
    """Places of template words in the texts of a slice: number of the word, of the document, and its ends."""

    def __init__(self, texts: list[bytes], numbers: dict[bytes, int]):
        words = [split_words(t) for t in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        find = numbers.get
        codes = np.fromiter((find(w, -1) for doc in words for w in doc), np.int64, int(self.sizes.sum()))
        self.place = np.flatnonzero(codes >= 0)
        self.code = codes[self.place]
        self.doc = np.searchsorted(self.ends, self.place, "right")


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """How many documents of the whole table hold each word of the templates."""
    names = vocabulary(templates)
    numbers = {w.encode(): i for i, w in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in slices(batches, text):
            hits = Hits(as_bytes(batch.column(text)), numbers)
            total += np.bincount(np.unique(hits.doc * len(names) + hits.code) % len(names), minlength=len(names))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in held], pa.string()), pa.array(total[held])], ["word", "n"])

    counts = docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(names, 0) | {r["word"]: r["n"] for r in counts.collect()}  # a row for each template word at most


class Index:
    """Templates as numbers in the global order of words, with their prefixes."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[str, int]):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.numbers = {w.encode(): i for i, w in enumerate(order)}
        of = {w: i for i, w in enumerate(order)}
        self.templates = templates
        self.sequences = [np.array([of[w] for w in t.words], np.int64) for t in templates]
        self.sets = [np.unique(s) for s in self.sequences]
        self.must = [np.array(sorted(of[w] for w in t.must), np.int64) for t in templates]
        self.never = [np.array(sorted(of[w] for w in t.never), np.int64) for t in templates]
        self.prefixes = []
        for t, words in zip(templates, self.sets):
            starts = np.zeros(len(order), bool)
            starts[words[: len(words) - t.needed + 1]] = True
            self.prefixes.append(starts)

    def candidates(self, number: int, hits: Hits) -> np.ndarray:
        """Blocks (document, first word in the slice, its end; rows) that pass the prefix filter and hold enough template words."""
        template = self.templates[number]
        mine = np.flatnonzero(self.prefixes[number][hits.code])
        doc, stride = hits.doc[mine], template.stride
        begin = hits.ends[doc] - hits.sizes[doc]
        block = (hits.place[mine] - begin) // stride
        both = np.concatenate([block, block - 1])
        rows = np.unique(np.stack([np.concatenate([doc, doc]), both], 1)[both >= 0], axis=0)
        doc, block = rows[:, 0], rows[:, 1]
        begin = hits.ends[doc] - hits.sizes[doc] + block * stride
        end = np.minimum(hits.ends[doc], begin + 2 * stride)
        low, high = np.searchsorted(hits.place, begin), np.searchsorted(hits.place, end)
        return np.stack([doc, low, high, begin, end], 1)[high - low >= template.needed]

    def containment(self, number: int, words: np.ndarray) -> float:
        """Share of the template's words among the ascending distinct ``words`` of a block; 0 if a filter or a condition fails."""
        mine, needed = self.sets[number], self.templates[number].needed
        if len(words) < needed:
            return 0.0
        common = np.intersect1d(mine, words, assume_unique=True)
        if not len(common):
            return 0.0
        rest = min(len(mine) - np.searchsorted(mine, common[0]), len(words) - np.searchsorted(words, common[0]))
        if rest < needed or len(common) < needed:
            return 0.0
        if not np.isin(self.must[number], words).all() or np.isin(self.never[number], words).any():
            return 0.0
        return len(common) / len(mine)

    def matches(self, hits: Hits) -> list[list[dict]]:
        """For every document its (template, label, first_word, end_word, containment); a phrase's places, or a notice's blocks."""
        found: list[dict] = [{} for _ in hits.sizes]
        for number, template in enumerate(self.templates):
            for doc, low, high, begin, end in self.candidates(number, hits).tolist():
                share = self.containment(number, np.unique(hits.code[low:high]))
                if share:
                    base = int(hits.ends[doc] - hits.sizes[doc])
                    spans = self.places(number, hits, low, high) if template.exact else [(begin, end)]
                    found[doc] |= {(number, a - base, b - base): share for a, b in spans}
        return [
            [{"template": n, "label": self.templates[n].label, "first_word": a, "end_word": b, "containment": share} for (n, a, b), share in sorted(spans.items())] for spans in found
        ]

    def places(self, number: int, hits: Hits, low: int, high: int) -> list[tuple[int, int]]:
        """Where the words of a phrase stand one after the other within a block."""
        words = self.sequences[number]
        size = len(words)
        code, place = hits.code[low:high], hits.place[low:high]
        out = []
        for i in np.flatnonzero(code[: len(code) - size + 1] == words[0]).tolist():
            if place[i + size - 1] - place[i] == size - 1 and (code[i : i + size] == words).all():
                out.append((int(place[i]), int(place[i]) + size))
        return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with n_words and ``matches``: for phrases their places, for notices the blocks that hold them."""
    index = Index(templates, frequencies(docs, templates, text))
    added = T._parse_datatype_string(RESULT)
    passed = [c for c in docs.columns if c not in added.fieldNames()]
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            hits = Hits(as_bytes(batch.column(text)), index.numbers)
            new = [pa.array(hits.sizes), pa.array(index.matches(hits), kind)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *new], [*passed, *added.fieldNames()])

    rows = docs.select(*[F.col(f"`{c}`") for c in passed])
    return rows.mapInArrow(search, T.StructType([*[rows.schema[c] for c in passed], *added.fields]))
