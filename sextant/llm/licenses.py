"""Licence scans: template triples find notices, a trained classifier with an unknown class judges them.

Paragraphs are the lines of a text between lines without a word, so a notice
may be wrapped over lines.  A template is confirmed where the share CONFIRM of
its word triples lies within some PIECE words of a paragraph, wherever these
begin, or where it has that share of the triples of a whole line, sentence or
paragraph that holds at least half of it (a shortened notice).

Features are hashed word n-grams of one to three words.  A sparse multinomial
logistic regression tells the licence families and ``unknown`` apart.  It is
trained on variants of the notices in TEMPLATES and, for ``unknown``, on the
paragraphs of a bounded sample of documents that share no word triple with any
template; a temperature is fitted on the part not trained on.  It scores the
words of each confirmed stretch: a notice counts if a licence is likelier than
``unknown`` (LIKELY), a shortened one if its family is likelier than all else.
Every confirmed family gives a row; of families that read the same words, as
CC-BY does in a CC-BY-NC notice, the likeliest does.

Texts in which no template can be confirmed are passed over by their triples
alone.  A row names the line on which the notice begins.

Documents never move.  Defined cases: null and empty text have no licence;
repeated rows give their own rows; with no documents to learn ``unknown`` from
the templates alone are learned; an empty table gives an empty result; only key
and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm import flatwords, linear

UNKNOWN = "unknown"
SIZE = 1 << 16
ORDERS = 3
PIECE = 64
#: Documents whose paragraphs teach ``unknown``, and paragraphs taken of each.
SAMPLE, SAMPLE_LINES = 1500, 8
VARIANTS = 60
LIKELY, CONFIRM = 0.5, 0.6
_SENTENCE_END = re.compile(r"(?<=[.!?;])\s+")

# Usual wordings of licence notices, by family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This software is released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL version 2 or later.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the MPL 2.0."],
    "Reserved": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without written permission."],
}


class Paragraphs:
    """Words and bounds of the single lines of many texts, cut into stretches of at most PIECE words; they teach."""

    def __init__(self, texts: list[str | None]):
        lines, owner, number = [], [], []
        for k, t in enumerate(texts):
            for i, line in enumerate((t or "").split("\n")):
                lines.append(line)
                owner.append(k)
                number.append(i)
        word, bounds = flatwords.words(lines)
        pieces = np.maximum(1, -(-np.diff(bounds) // PIECE)) if lines else np.zeros(0, np.int64)
        line = np.repeat(np.arange(len(lines)), pieces)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = bounds[:-1][line] + nth * PIECE if lines else np.zeros(0, np.int64)
        self.word = word
        self.bounds = np.append(start, len(word)).astype(np.int64)
        self.text = np.array(owner, np.int64)[line]
        self.line = np.array(number, np.int64)[line]

    def triples(self) -> list[np.ndarray]:
        """Distinct word triples of each paragraph."""
        s, cut = flatwords.shingles(self.word, self.bounds, ORDERS)
        return [np.unique(s[a:b]) for a, b in zip(cut, cut[1:])]


def _grams(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and the paragraph each lies in."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    value, out, where = np.zeros(len(word), np.uint64), [], []
    for n in range(ORDERS):
        value = value[: len(word) - n] * np.uint64(0x9E3779B97F4A7C15) + word[n:]
        whole = owner[: len(value)] == owner[n:]
        out.append((flatwords.mix(value[whole]) >> np.uint64(48)).astype(np.int64))
        where.append(owner[: len(value)][whole])
    return np.concatenate(out), np.concatenate(where)


def _rows(p: Paragraphs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each paragraph: presence, scaled to length one."""
    gram, where = _grams(p.word, p.bounds)
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(len(p.text) + 1))
    out = []
    for a, b in zip(cut, cut[1:]):
        at = np.unique(gram[order[a:b]])
        out.append((at, np.full(len(at), 1 / np.sqrt(max(1, len(at))))))
    return out


def train(other: list[str]) -> dict:
    """Model from the templates and from paragraphs without a licence."""
    names = [UNKNOWN, *TEMPLATES]
    known = [Paragraphs(t).triples() for t in TEMPLATES.values()]
    every = np.unique(np.concatenate([x for f in known for x in f]))
    seen = Paragraphs(other)
    alike = {int(k) for k, x in zip(seen.text, seen.triples()) if not len(x) or np.isin(x, every).any()}
    plain = [t for k, t in enumerate(other) if k not in alike]
    rng = np.random.default_rng(11)
    texts, labels = list(plain), [0] * len(plain)
    fill = [w for t in plain[:200] for w in t.split()] or ["text"]
    for k, (family, wordings) in enumerate(TEMPLATES.items(), 1):
        for v in range(VARIANTS):
            w = wordings[v % len(wordings)].split()
            if v >= len(wordings):  # some words go, some of other text come before or after
                w = [x for x in w if rng.random() > 0.05] or w
                w = [*rng.choice(fill, rng.integers(0, 4)), *w, *rng.choice(fill, rng.integers(0, 4))]
            texts.append(" ".join(w))
            labels.append(k)
    taught = Paragraphs(texts)
    rows, label = _rows(taught), np.array(labels)[taught.text]
    apart = np.arange(len(rows)) % 5 == 4
    w = linear.fit_ftrl([r for r, x in zip(rows, apart) if not x], label[~apart], len(names), SIZE, l1=0.05)
    scores = np.array([x @ w[a] + w[SIZE] for (a, x), out in zip(rows, apart) if out]).reshape(-1, len(names))
    return {"names": names, "weights": w, "temperature": linear.fit_temperature(scores, label[apart]), "templates": known}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line, family, probability, template, likeness) of the paragraphs that hold a licence."""
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = F.xxhash64(F.col("key").cast("string"), F.lit(3))
    # A bounded sample of documents with a bound on their paragraphs teaches "unknown".
    lines = F.slice(F.split("text", "\n"), 1, SAMPLE_LINES)
    # Long lines are cut to the words a stretch can hold, and only these lines are ordered.
    short = F.transform(lines, lambda x: F.array_join(F.slice(F.split(F.substring(x, 1, 2000), " "), 1, PIECE), " "))
    sample = pairs.where("text is not null").select(order.alias("ticket"), "key", short.alias("lines"))
    sample = sample.orderBy("ticket", "key").limit(SAMPLE).select(F.explode("lines").alias("line"))
    model = train(sorted(r["line"] for r in sample.collect()))
    names, w, known = model["names"], model["weights"], model["templates"]
    used = np.flatnonzero((w[:SIZE] != 0).any(axis=1))
    bias, small, temperature = w[SIZE], w[used], model["temperature"]
    place = np.full(SIZE, -1, np.int32)
    place[used] = np.arange(len(used))

    schema = T.StructType(
        [T.StructField(key, pairs.schema["key"].dataType), T.StructField("line", T.LongType()), T.StructField("family", T.StringType()),
         T.StructField("probability", T.DoubleType()), T.StructField("template", T.IntegerType()), T.StructField("likeness", T.DoubleType())]
    )

    def chances(word: np.ndarray) -> np.ndarray:
        """Chance of every name for one stretch of words; presence counts, scaled by all distinct n-grams."""
        gram = np.unique(_grams(word, np.array([0, len(word)]))[0])
        mine = place[gram]
        return linear.softmax(((small[mine[mine >= 0]].sum(axis=0) / np.sqrt(max(1, len(gram))) + bias) / temperature)[None])[0]

    search = _Search(known)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["key"], batch["text"].tolist()
            for a, b in flatwords.portions(texts):
                found = [(t, *_row(n)) for t in search.worth(texts[a:b]) for n in _settled(search.notices(texts[a + t], chances))]
                if found:
                    t, rest = [f[0] for f in found], [f[1:] for f in found]
                    out = pd.DataFrame(rest, columns=[f.name for f in schema][1:])
                    out.insert(0, key, keys.iloc[a:b].iloc[t].to_numpy())
                    yield out

    def _row(n: Notice) -> tuple:
        return n.line, names[n.family], round(float(n.chance[n.family]), 6), n.template, round(n.like, 6)

    return pairs.mapInPandas(judge, schema)


class Notice(NamedTuple):
    """A stretch of words, first to end, that confirms a template; ``at`` are the places of the matched triples."""

    family: int
    template: int
    like: float
    first: int
    end: int
    at: frozenset
    line: int
    chance: np.ndarray


class _Search:
    """Places where templates are confirmed."""

    def __init__(self, known: list[list[np.ndarray]]):
        self.named = [(f, k) for f, templates in enumerate(known, 1) for k in range(len(templates))]
        self.triples = [t for templates in known for t in templates]
        self.need = np.array([-(-len(t) // 2) for t in self.triples])
        self.every = np.unique(np.concatenate(self.triples))
        self.holds = np.stack([np.isin(self.every, t) for t in self.triples])

    def _hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of template triples among the given ones, and which they are."""
        which = np.minimum(np.searchsorted(self.every, s), len(self.every) - 1)
        at = np.flatnonzero(self.every[which] == s)
        return at, which[at]

    def worth(self, texts: list[str | None]) -> list[int]:
        """Texts with at least half of some template's triples, line breaks aside; no other can confirm one."""
        s, cut = flatwords.shingles(*flatwords.words(texts), ORDERS)
        at, which = self._hits(s)
        pair = np.unique((np.searchsorted(cut, at, side="right") - 1) * len(self.every) + which)
        text, first = np.unique(pair // len(self.every), return_index=True)
        has = np.split(pair % len(self.every), first[1:])
        return [int(t) for t, h in zip(text, has) if (self.holds[:, h].sum(axis=1) >= self.need).any()]

    def notices(self, text: str, chances: Callable[[np.ndarray], np.ndarray]) -> list[Notice]:
        """Confirmed templates that the classifier takes for a licence, the same words perhaps by several."""
        pieces, line, sentence = [], [], []
        nth = 0
        for i, row in enumerate(text.split("\n")):
            for k, piece in enumerate(_SENTENCE_END.split(row)):
                nth += k > 0
                pieces.append(piece)
                line.append(i)
                sentence.append(nth)
            nth += bool(row) and row.rstrip()[-1:] in set(".!?;")
        word, bounds = flatwords.words(pieces)
        count = np.diff(bounds)
        line = np.repeat(line, count)
        # A line without words ends a paragraph.
        paragraph = np.cumsum(np.diff(line, prepend=line[:1]) > 1)
        sentence = paragraph * (nth + 1) + np.repeat(sentence, count)
        cut = np.append(np.searchsorted(paragraph, np.arange(paragraph[-1] + 1)), len(word))
        s, start = flatwords.shingles(word, cut, ORDERS)
        at, which = self._hits(s)
        owner = np.searchsorted(start, at, side="right") - 1
        at = at - start[owner] + cut[owner]  # now places of words
        found = []

        def add(g: int, like: float, first: int, end: int, its: np.ndarray, whole: tuple[int, int] | None) -> None:
            family, template = self.named[g]
            words = word[first:end] if whole is None else word[whole[0] : whole[1]]
            chance = chances(words)
            if (chance[0] <= 1 - LIKELY) if whole is None else (chance.argmax() == family and chance[family] >= LIKELY):
                found.append(Notice(family, template, like, first, end, frozenset(its.tolist()), int(line[first]), chance))

        for g, triples in enumerate(self.triples):
            mine = np.flatnonzero(self.holds[g][which])
            if len(np.unique(which[mine])) < self.need[g]:
                continue
            p, kind, size = at[mine], which[mine], len(triples)
            for like, i, j in _windows(p, kind, paragraph[p], size):
                add(g, like, int(p[i]), int(p[j]) + ORDERS, p[i : j + 1], None)
            for unit in (line, sentence, paragraph):
                inside = unit[p] == unit[np.minimum(p + ORDERS - 1, len(word) - 1)]
                ip, ik = p[inside], kind[inside]
                if not len(ip):
                    continue
                for part in np.split(np.arange(len(ip)), np.flatnonzero(np.diff(unit[ip])) + 1):
                    both = len(np.unique(ik[part]))
                    if both >= self.need[g]:
                        a, b = np.searchsorted(unit, unit[ip[part[0]]]), np.searchsorted(unit, unit[ip[part[0]]], side="right")
                        of_unit = np.unique(flatwords.shingles(word[a:b], np.array([0, b - a]), ORDERS)[0])
                        like = both / len(of_unit)
                        if like >= CONFIRM:
                            add(g, max(like, both / size), int(ip[part[0]]), int(ip[part[-1]]) + ORDERS, ip[part], (int(a), int(b)))
        return found


def _windows(p: np.ndarray, kind: np.ndarray, paragraph: np.ndarray, size: int) -> list[tuple[float, int, int]]:
    """Stretches of at most PIECE words with the share CONFIRM of a template: (share, first hit, last hit).

    Of stretches that overlap the one of the greatest share stays, then the shortest.
    """
    out, best, left, count = [], None, 0, {}
    for right in range(len(p)):
        count[kind[right]] = count.get(kind[right], 0) + 1
        while paragraph[left] != paragraph[right] or p[right] + ORDERS - p[left] > PIECE or count[kind[left]] > 1:
            # What comes again later is not needed at the start.
            count[kind[left]] -= 1
            if not count[kind[left]]:
                del count[kind[left]]
            left += 1
        like = len(count) / size
        if like < CONFIRM:
            continue
        if best is not None and p[left] >= p[best[2]] + ORDERS:
            out.append(best)
            best = None
        if best is None or (like, p[best[2]] - p[best[1]]) > (best[0], p[right] - p[left]):
            best = (like, left, right)
    return out if best is None else [*out, best]


def _settled(found: list[Notice]) -> list[Notice]:
    """All families' notices; of a family's stretches that overlap, the one with most triples.

    Families that share more than half of the matched triples of one read the
    same words: the likeliest stays.  Others stand side by side, as in a dual licence.
    """
    best: list[Notice] = []
    end, family = 0, 0
    for n in sorted(found, key=lambda n: (n.family, n.first)):
        if n.family != family or n.first >= end:
            best.append(n)
            family, end = n.family, n.end
            continue
        end = max(end, n.end)
        best[-1] = min(best[-1], n, key=lambda n: (-len(n.at), -n.like, n.end - n.first, n.template))
    by: dict[int, list[int]] = {}
    kept: list[Notice] = []
    for n in sorted(best, key=lambda n: (-n.chance[n.family], -n.like, n.first, n.family)):
        shared = Counter(k for at in n.at for k in by.get(at, ()))
        if all(2 * c <= min(len(n.at), len(kept[k].at)) for k, c in shared.items()):
            for at in n.at:
                by.setdefault(at, []).append(len(kept))
            kept.append(n)
    return sorted(kept, key=lambda n: (n.first, n.family))
