"""License scans by a generalised suffix automaton of licence tokens.

The automaton is built over the words of all templates. Streaming a file through it gives, at each
word, how long the longest run of words is that ends there and occurs in a template, and by the
suffix links the same for each template. Runs of at least MIN_MATCH words that can't be extended are
matches; matches in the order of a template, with at most MAX_GAP other words between two of them,
are chained, and a chain that covers MIN_COVERAGE of the template's words is a span, unless it lies within
another that covers more words.

Templates are notices, given here, and whole texts: each file of a folder, read on the driver, is a template.
LICENCES_FOLDER is where Linux systems keep the most common ones; any other can be given, or a list of
templates.

A match of MIN_MATCH words starts with a trigram of some template, so only runs of such trigrams,
which array steps find, are streamed: what remains outside of them can't be part of any match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import load
from hvspark.llm.tokens import Tokens, blocks, tokenize, utf8, window_hashes

MIN_MATCH = 3  #: words; also the length of the windows that start a stream
MAX_GAP = 8
MIN_COVERAGE = 0.75
LICENCES_FOLDER = "/usr/share/common-licenses"

#: (template, licence, its words); pieces of a longer text are joined by blanks.
TEMPLATES = (
    ("apache-2.0-notice", "Apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    ("apache-2.0-terms", "Apache-2.0", ("you may not use this file except", "in compliance with the License.", "You may obtain a copy of the License at")),
    ("apache-2.0-disclaimer", "Apache-2.0", ("Unless required by applicable law or agreed to in writing,", "software distributed under the License is distributed", "on an \"AS IS\" BASIS")),
    ("mit-notice", "MIT", ("Released under the MIT License",)),
    ("mit-notice-2", "MIT", ("Licensed under the MIT License",)),
    ("mit-grant", "MIT", ("Permission is hereby granted, free of charge,", "to any person obtaining a copy of this software", "and associated documentation files,", "to deal in the Software without restriction")),
    ("mit-warranty", "MIT", ("THE SOFTWARE IS PROVIDED \"AS IS\",", "WITHOUT WARRANTY OF ANY KIND,", "EXPRESS OR IMPLIED")),
    ("gpl-3.0-notice", "GPL-3.0", ("This work is licensed under the GNU General Public License, version 3",)),
    ("gpl-header", "GPL", ("This program is free software:", "you can redistribute it and/or modify it under the terms", "of the GNU General Public License as published by", "the Free Software Foundation")),
    ("lgpl-header", "LGPL", ("redistribute it and/or modify it under the terms", "of the GNU Lesser General Public License")),
    ("agpl-notice", "AGPL-3.0", ("under the terms of the GNU Affero General Public License",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("Licensed under CC BY 4.0",)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0",)),
    ("cc-by-long", "CC-BY", ("This work is licensed under a Creative Commons Attribution",)),
    ("bsd-conditions", "BSD", ("Redistribution and use in source and binary forms,", "with or without modification, are permitted", "provided that the following conditions are met")),
    ("bsd-3-clause", "BSD-3-Clause", ("may be used to endorse or promote products", "derived from this software without specific prior written permission")),
    ("isc-grant", "ISC", ("Permission to use, copy, modify, and/or distribute this software", "for any purpose with or without fee is hereby granted")),
    ("mpl-2.0-notice", "MPL-2.0", ("subject to the terms of the Mozilla Public License, v. 2.0",)),
    ("unlicense", "Unlicense", ("This is free and unencumbered software", "released into the public domain")),
    ("all-rights-reserved", "proprietary", ("All rights reserved",)),
)


class Automaton:
    """The generalised suffix automaton of token sequences; for each state, where it ends in each."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = []
        marks: list[tuple[int, int, int]] = []
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                marks.append((last, s, i + 1))
        ends: list[dict[int, set[int]]] = [defaultdict(set) for _ in self.next]
        for state, s, i in marks:
            ends[state][s].add(i)
        for state in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            if self.link[state] > 0 and self.length[self.link[state]] >= MIN_MATCH:  # shorter ones are never asked
                for s, places in ends[state].items():
                    ends[self.link[state]][s] |= places
        self.ends = [{s: sorted(p) for s, p in e.items()} for e in ends]

    def _extend(self, last: int, token: int) -> int:
        there = self.next[last].get(token)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, token, there)
        new = self._state({}, self.length[last] + 1, 0)
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][token]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, token, there)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, last: int, token: int, there: int) -> int:
        twin = self._state(dict(self.next[there]), self.length[last] + 1, self.link[there])
        self.link[there] = twin
        while last >= 0 and self.next[last].get(token) == there:
            self.next[last][token] = twin
            last = self.link[last]
        return twin

    def statistics(self, tokens: list[int]) -> list[dict[int, tuple[int, int]]]:
        """At each token, for each sequence: length of the longest run that ends there, and its state; of MIN_MATCH at least."""
        out, state, length = [], 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            here: dict[int, tuple[int, int]] = {}
            s, n = state, length
            while n >= MIN_MATCH:
                for k in self.ends[s]:
                    here.setdefault(k, (n, s))
                s = self.link[s]
                n = self.length[s] if s >= 0 else 0
            out.append(here)
        return out


def whole_texts(folder: str = LICENCES_FOLDER) -> tuple:
    """Templates from the files of a folder, by name; of files with the same text the one with the longest name."""
    texts: dict[str, str] = {}
    for f in sorted((x for x in Path(folder).glob("*") if x.is_file()), key=lambda x: (len(x.name), x.name)):
        texts[f.read_text(errors="replace")] = f.name
    return tuple((f"{name.lower()}-text", name, (text,)) for text, name in sorted(texts.items(), key=lambda x: x[1]))


def best_chains(matches: list[tuple[int, int, list[int]]], size: int) -> list[tuple[int, int, int]]:
    """(covered, first word, end) of the best chain that ends with each match.

    A match is chained only to matches that end no more than MAX_GAP words before it begins, so
    only these are looked at: the time grows with the matches, not with their square.
    """
    best: list[tuple[int, int, int, int]] = []  # covered, first word, end, end in the template
    ends: list[int] = []
    out = []
    for end, length, places in matches:
        near = bisect_left(ends, end - length - MAX_GAP)
        here = []
        for place in places:
            top = (length, end - length)
            for covered, first, before, at in best[near:]:
                gain = min(length, end - before, place - at)  # without what overlaps
                if gain > 0 and end - gain - before <= MAX_GAP:
                    top = max(top, (covered + gain, first), key=lambda x: (x[0], -x[1]))
            here.append((*top, end, place))
        best += here
        ends += [end] * len(here)
        out.append(max(((c, f, e) for c, f, e, _ in here), key=lambda x: (x[0], -x[1])))
    return out


def chains(matches: list[tuple[int, int, list[int]]], size: int) -> list[tuple[int, int, int]]:
    """(first word, end, covered words) of a template's spans; matches: (end, length, ends in the template) by end.

    Of all chains the one that covers most is taken, the first among equals, then the best of what
    lies outside of it, and so on, as long as MIN_COVERAGE is reached. Chains that no better one
    overlaps don't wait for each other, so a few rounds do for any number of spans.
    """
    out: list[tuple[int, int, int]] = []
    while matches and sum(n for _, n, _ in matches) >= MIN_COVERAGE * size:
        found = sorted((c for c in set(best_chains(matches, size)) if c[0] >= MIN_COVERAGE * size), key=lambda x: (-x[0], x[1], x[2]))
        if not found:
            break
        low = min(f for _, f, _ in found)
        claimed = np.zeros(max(e for _, _, e in found) - low, np.bool_)
        taken = np.zeros(len(claimed), np.bool_)
        for covered, first, end in found:
            if not claimed[first - low : end - low].any():
                out.append((first, end, covered))
                taken[first - low : end - low] = True
            claimed[first - low : end - low] = True
        run = np.concatenate([[0], np.cumsum(taken)])
        at = lambda x: run[min(max(x - low, 0), len(taken))]
        matches = [m for m in matches if at(m[0]) == at(m[0] - m[1])]
    return sorted(out)


def outermost(spans: list[tuple[int, int, int]]) -> list[bool]:
    """Of (first, end, covered), which lie within no other that covers more words.

    By first word, long ones first; a Fenwick tree over the ends holds the most that any span to
    the left covers and that ends no earlier.
    """
    ends = sorted({e for _, e, _ in spans}, reverse=True)
    place = {e: i + 1 for i, e in enumerate(ends)}
    most = [0] * (len(ends) + 1)
    out = [True] * len(spans)
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], -spans[i][2]))
    for i in order:  # of equal ones in place, those that cover more come first
        _, end, covered = spans[i]
        k, top = place[end], 0
        while k:
            top = max(top, most[k])
            k -= k & -k
        out[i] = top <= covered
        k = place[end]
        while k < len(most):
            most[k] = max(most[k], covered)
            k += k & -k
    return out


@lru_cache(maxsize=2)
def _library(templates: tuple) -> Library:
    """One automaton a worker."""
    return Library(templates)


class Library:
    def __init__(self, templates=TEMPLATES):
        self.names = [(name, licence) for name, licence, _ in templates]
        data, at = utf8(pa.array([" ".join(parts) for _, _, parts in templates], pa.large_string()))
        t = tokenize(data[at[0] : at[-1]], at - at[0])
        sequences = [t.hash[a:b].tolist() for a, b in zip(t.first, t.first[1:])]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        starts = [window_hashes(np.array(s, np.uint64), MIN_MATCH) for s in sequences if len(s) >= MIN_MATCH]
        self.starts = np.unique(np.concatenate([*starts, np.empty(0, np.uint64)]).astype(np.uint64))
        self.bits = np.zeros(1 << 16, np.bool_)
        self.bits[(self.starts >> np.uint64(48)).astype(np.int64)] = True

    def runs(self, t: Tokens) -> list[tuple[int, int]]:
        """Places of words, first and end, outside of which nothing can match."""
        if len(t.hash) < MIN_MATCH or not len(self.starts):
            return []
        h = window_hashes(t.hash, MIN_MATCH)
        at = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)] & (t.row[: len(h)] == t.row[MIN_MATCH - 1 :]))
        at = at[self.starts[np.minimum(np.searchsorted(self.starts, h[at]), len(self.starts) - 1)] == h[at]]
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(t.row[at]) > 0)) + 1
        return [(int(x[0]), int(x[-1]) + MIN_MATCH) for x in np.split(at, cut)]

    def spans(self, t: Tokens) -> list[tuple[int, int, int, int, int]]:
        """(row, template, first word, end, covered words)."""
        found: dict[tuple[int, int], list[tuple[int, int, list[int]]]] = defaultdict(list)
        for lo, hi in self.runs(t):
            stats = self.automaton.statistics(t.hash[lo:hi].tolist())
            row = int(t.row[lo])
            for i, here in enumerate(stats):
                then = stats[i + 1] if i + 1 < len(stats) else {}
                for k, (n, state) in here.items():
                    if then.get(k, (0, 0))[0] != n + 1:
                        found[row, k].append((lo + i + 1, n, self.automaton.ends[state][k]))
        spans = sorted((row, k, *span) for (row, k), matches in found.items() for span in chains(matches, self.sizes[k]))
        by_row = defaultdict(list)
        for span in spans:
            by_row[span[0]].append(span)
        kept = (x for own in by_row.values() for x, stays in zip(own, outermost([y[2:] for y in own])) if stays)
        return sorted(kept)


_SCHEMA = "doc_id bigint, template string, licence string, first_word bigint, end_word bigint, first_byte bigint, end_byte bigint, covered int, coverage double"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, template, licence, span in words and bytes, covered, coverage): a row for each span.

    Spans of several templates may overlap. Null and empty texts have none; rows that repeat give
    rows that repeat; a null doc_id stays one; a template of fewer than MIN_MATCH words is never found.
    Texts of any length are read whole, in time that grows with their matches. Other columns of
    docs don't matter, whatever their names.
    """
    given = tuple((name, licence, tuple(parts)) for name, licence, parts in templates)
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def run(batches):
        library = _library(shared.value)
        for b in batches:
            for lo, _, data, offsets in blocks(b.column(1)):
                t = tokenize(data, offsets)
                found = library.spans(t)
                if found:
                    row, k, first, end, covered = (np.array(x) for x in zip(*found))
                    base, start = t.first[row], offsets[row]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row + lo)), pa.array([library.names[x][0] for x in k]), pa.array([library.names[x][1] for x in k]), pa.array(first - base), pa.array(end - base), pa.array(t.start[first] - start), pa.array(t.end[end - 1] - start), pa.array(covered.astype(np.int32)), pa.array(covered / np.array(library.sizes)[k])],
                        ["doc_id", "template", "licence", "first_word", "end_word", "first_byte", "end_byte", "covered", "coverage"],
                    )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"), TEMPLATES + whole_texts())


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
