"""License scan: an exact set-similarity join of text blocks with license templates.

A block is any run of `block_words` words of a document, wherever it begins (or the
whole document, if that is shorter).  A block meets a template when it contains at
least `threshold` of the template's distinct words; every block that does is found.
Tokens are ordered by their frequency over all documents, rarest first.  A template
is indexed by its prefix, the first |T| - need + 1 tokens: a block that holds none of
them can't hold `need` tokens.  So blocks need be looked for only around places of
prefix tokens.  The length filter drops a place with fewer than `need` tokens of the
template within reach of a block, the positional filter one with fewer among those
that come no earlier in the order (of a block's rarest token, all its others do so).
Around what is left, one pass counts the distinct tokens of every block.

Base: places where the words of a phrase stand one after another.

Cases: a null or empty text has no words, no labels and score 0; repeated rows
are scanned each for themselves; phrases and blocks don't cross documents; texts
are scanned whole, however long; ties in frequency go by the word itself; columns
other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _core

#: The phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known license notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
]
THRESHOLD = 0.8
BLOCK_WORDS = 96


class Templates:
    """The vocabulary of the templates, and once ordered() their prefix index."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD):
        self.labels = [label for label, _ in templates]
        w = _core.Words([t.encode() for _, t in templates], _core.ALNUM, lower=True)
        p = _core.Words([t.encode() for t in phrases], _core.ALNUM, lower=True)
        self.words = np.unique(np.concatenate([w.hash, p.hash]))
        place = np.searchsorted(self.words, w.hash)
        self.sets = [np.unique(place[w.first[i] : w.first[i + 1]]) for i in range(len(templates))]
        own = np.searchsorted(self.words, p.hash)
        self.phrases = [(own[p.first[i] : p.first[i + 1]], label) for i, label in enumerate(phrases.values())]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]

    def ordered(self, frequency: np.ndarray) -> Templates:
        """Orders tokens by frequency and indexes the prefixes of the templates."""
        order = np.empty(len(self.words), dtype=np.int64)
        order[np.lexsort((self.words, frequency))] = np.arange(len(self.words))
        self.rank = np.full((len(self.sets), len(self.words)), -1, dtype=np.int64)  # of a word within each template
        self.prefix = np.zeros(len(self.words), dtype=bool)  # of any template
        for t, own in enumerate(self.sets):
            own = own[np.argsort(order[own])]
            self.rank[t, own] = np.arange(len(own))
            self.prefix[own[: len(own) - self.need[t] + 1]] = True
        return self

    def met(self, t: int, at: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where blocks end that meet template t, and their distinct words of it.  at: places of
        template words in ascending order; word: which; first, last: of the document each lies in."""
        rank, need = self.rank[t, word], self.need[t]
        own = rank >= 0
        at, rank, first, last = at[own], rank[own], first[own], last[own]
        least = rank < len(self.sets[t]) - need + 1
        if not least.any():
            return at[:0], at[:0]
        low = lambda p, f: np.maximum(p - size + 1, f)  # noqa: E731  what a block around p can reach
        high = lambda p, l: np.minimum(p + size - 1, l)
        count = lambda x, p, f, l: np.searchsorted(x, high(p, l), "right") - np.searchsorted(x, low(p, f))
        least[least] = count(at, at[least], first[least], last[least]) >= need  # length
        for r in np.unique(rank[least]).tolist():  # position
            some = least & (rank == r)
            least[some] = count(at[rank >= r], at[some], first[some], last[some]) >= need
        if not least.any():
            return at[:0], at[:0]
        step = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(step, np.searchsorted(at, low(at[least], first[least])), 1)
        np.add.at(step, np.searchsorted(at, high(at[least], last[least]), "right"), -1)
        near = np.cumsum(step[:-1]) > 0
        at, rank, last = at[near], rank[near], last[near]
        # a word counts for blocks that end between its place and where it comes again or is out of reach
        order = np.lexsort((at, rank))
        again = np.full(len(at), np.iinfo(np.int64).max)
        same = rank[order[1:]] == rank[order[:-1]]
        again[order[:-1][same]] = at[order[1:][same]]
        ends = np.sort(np.minimum(np.minimum(again - 1, at + size - 1), last))
        distinct = np.arange(1, len(at) + 1) - np.searchsorted(ends, at)
        good = distinct >= need
        return at[good], distinct[good]


def frequencies(docs: DataFrame, templates: Templates, text_col: str = "text") -> np.ndarray:
    """How often each template word occurs, over all documents."""

    def make():
        find = _core.lookup(templates.words)

        def work(_, texts):
            place = find(_core.Words(texts, _core.ALNUM, lower=True).hash)
            count = np.bincount(place[place >= 0], minlength=len(templates.words))
            some = np.flatnonzero(count)
            return {"token": some, "n": count[some]}

        return work

    out = np.zeros(len(templates.words), dtype=np.int64)
    for r in _core.map_texts(docs, make, "token long, n long", (), text_col).groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r.token] = r.n
    return out


def scan(docs: DataFrame, templates: Templates, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document the base places, and the labels and best containment of the join.
    `templates` must be ordered()."""
    def make():
        find = _core.lookup(templates.words)

        def work(cols, texts):
            w = _core.Words(texts, _core.ALNUM, lower=True)
            place, owner = find(w.hash), w.owner()
            labels = [set() for _ in texts]
            base = [set() for _ in texts]
            n_base = np.zeros(len(texts), dtype=np.int64)
            low, high = np.full(len(texts), -1, dtype=np.int64), np.full(len(texts), -1, dtype=np.int64)
            for phrase, label in templates.phrases:
                n = len(place) - len(phrase) + 1
                if n <= 0:
                    continue
                at = np.flatnonzero(place[:n] == phrase[0])
                for k in range(1, len(phrase)):
                    at = at[(place[at + k] == phrase[k]) & (owner[at + k] == owner[at])]
                for i, word in zip(owner[at].tolist(), (at - w.first[owner[at]]).tolist()):
                    n_base[i] += 1
                    base[i].add(label)
                    low[i] = word if low[i] < 0 else min(low[i], word)
                    high[i] = max(high[i], word)
            score = np.where(n_base > 0, 1.0, 0.0)
            at = np.flatnonzero(place >= 0)
            if len(at) and templates.prefix[place[at]].any():
                word, first, last = place[at], w.first[owner[at]], w.first[owner[at] + 1] - 1
                for t, label in enumerate(templates.labels):
                    ends, count = templates.met(t, at, word, first, last, block_words)
                    for i, c in zip(owner[ends].tolist(), count.tolist()):
                        labels[i].add(label)
                        score[i] = max(score[i], c / len(templates.sets[t]))
            return {
                "doc_id": cols[0], "n_words": w.counts, "n_base": n_base,
                "first_word": [int(x) if x >= 0 else None for x in low], "last_word": [int(x) if x >= 0 else None for x in high],
                "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x | y)) for x, y in zip(base, labels)], "score": score,
            }

        return work

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return _core.map_texts(docs, make, ddl, (id_col,), text_col)


def op3_license_scan(spark, sf_dir) -> DataFrame:
    docs = _core.read_table(spark, sf_dir, "documents")
    templates = Templates()
    return scan(docs, templates.ordered(frequencies(docs, templates)))
