"""License scans: winnowed template fingerprints in an inverted index pick candidates; banded alignment reports coverage and spans."""

from __future__ import annotations

import pathlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtable import chunks

#: Texts of license notices by name.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Whole public licence texts, a file each beside this module, and what their names end with here.
TEXTS, FULL = pathlib.Path(__file__).parent / "license_texts", "-full"
WORD = re.compile(r"\w+")
GRAM, WINNOW = 3, 2  # words of a fingerprint, k-grams of a window: every shared run of GRAM + WINNOW - 1 words is seen
INDEX_WORDS = 200_000  # words of the templates of one index, about; more templates make more indexes and passes
CELLS = 1_000_000  # of alignment matrices that are held at once, about
CACHED = 300_000
_ONE = np.int64(1 << 24)  # a score of 1; matched words are counted below it


def all_templates() -> dict[str, str]:
    """The notices, and the whole texts under their names with FULL."""
    return TEMPLATES | {p.stem + FULL: p.read_text() for p in sorted(TEXTS.glob("*.txt"))}


class Index:
    """Templates as word ids, and the inverted index of their winnowed fingerprints: sorted codes of k-grams beside (template, place), for each k."""

    def __init__(self, templates: list[tuple[str, list[str]]]) -> None:
        self.names = [n for n, _ in templates]
        vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in templates for w in ws}))}
        self.base = len(vocabulary) + 1
        self.vocabulary, self.cache = vocabulary, {}
        self.words = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in templates]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            k = min(GRAM, len(ids))
            code = self.codes(ids, k)
            found[k] += [(int(code[i]), t, i) for i in winnow(code.tolist(), WINNOW)]
        self.posting = {k: np.array(sorted(rows), np.int64).T for k, rows in found.items()}

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(max(0, len(ids) - k + 1), np.int64)
        for i in range(k):
            out = out * self.base + ids[i : i + len(out)]
        return out

    def read(self, words: list[str]) -> list[int]:
        """Ids of words, 0 for those that no template has."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        out = []
        for w in words:
            i = self.cache.get(w)
            if i is None:
                i = self.vocabulary.get(w.lower(), 0)
                if len(w) <= 48:
                    self.cache[w] = i
            out.append(i)
        return out


def winnow(grams: list[int], window: int) -> set[int]:
    """Places of the least k-gram of each window, the leftmost of equal ones."""
    last = max(1, len(grams) - window + 1)
    return {min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j] * 0x9E3779B97F4A7C15 % (1 << 64), j)) for i in range(last)} if grams else set()


def build_indexes(templates: dict[str, str]) -> list[Index]:
    """Indexes of about INDEX_WORDS words each. A template of fewer words than a fingerprint is one fingerprint of all; those without words are left out."""
    parts, size = [[]], 0
    for name, text in templates.items():
        if words := WORD.findall((text or "").lower()):
            if parts[-1] and size + len(words) > INDEX_WORDS:
                parts, size = [*parts, []], 0
            parts[-1].append((name, words))
            size += len(words)
    return [Index(p) for p in parts if p]


def align(template: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignments of whole templates, one for each (low, high, shift), with words[low:high] near the diagonal that puts template word i beside word i + shift. template: one for all, or a row for each alignment, all of one length.

    Matches score 2, substitutions -1, gaps -1; words before and after the match are free. The best score counts, then more matched words; among equal steps a word beside a word comes before a missing template word, that before a
    word that the template lacks, and among equal ends the one nearest to the diagonal, the lower one first. Returns matched words, and the first and the last word matched, exclusive (0, 0, 0 without a match). Rows advance together, one
    template word at a time; gaps along a row are a running maximum.
    """
    template = np.atleast_2d(template)
    m, width = template.shape[1], 2 * band + 1
    column = np.arange(width)
    place = shift[:, None] + np.arange(-band, m + band)
    inside = (place >= low[:, None]) & (place < high[:, None])
    window = np.where(inside, words[np.clip(place, 0, len(words) - 1)], -1)
    score = np.zeros((len(shift), width), np.int64)
    first, last = np.full(score.shape, -1, np.int64), np.full(score.shape, -1, np.int64)
    least = np.iinfo(np.int64).min // 4
    for i in range(m):
        here, valid, at = window[:, i : i + width], inside[:, i : i + width], place[:, i : i + width]
        same = here == template[:, i : i + 1]
        beside = np.where(valid, score + np.where(same, 2 * _ONE + 1, -_ONE), least)
        missing = np.full(score.shape, least)
        missing[:, :-1] = score[:, 1:] - _ONE
        step = beside >= missing
        best = np.where(step, beside, missing)
        pad = lambda x: np.concatenate([x[:, 1:], x[:, -1:]], axis=1)
        first2 = np.where(step, np.where(same & (first < 0), at, first), pad(first))
        last2 = np.where(step, np.where(same, at, last), pad(last))
        before = np.cumsum(valid, axis=1) == 0  # columns before the text; a gap may begin at the last of them
        before[:, :-1] &= before[:, 1:]
        reach = np.where(before, least, best) + column * _ONE
        top = np.maximum.accumulate(reach, axis=1)
        source = np.maximum.accumulate(np.where(reach == top, column, 0), axis=1)
        gap = valid & (source < column)
        score = np.where(gap, top - column * _ONE, best)
        first = np.where(gap, np.take_along_axis(first2, source, axis=1), first2)
        last = np.where(gap, np.take_along_axis(last2, source, axis=1), last2)
    order = np.argsort(np.abs(column - band), kind="stable")
    end = order[score[:, order].argmax(axis=1)]
    row = np.arange(len(shift))
    matched = score[row, end] & int(_ONE - 1)
    return matched, np.where(matched > 0, first[row, end], 0), np.where(matched > 0, last[row, end] + 1, 0)


def alike(index: Index, asked: np.ndarray, words: np.ndarray, low_of: np.ndarray, high_of: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of what is asked (rows template, text, diagonal) once each, without those that cannot reach the coverage, as their words near the diagonal show: by length of template, so that many templates are aligned together."""
    if asked.shape[1]:
        asked = asked[:, np.lexsort(asked[::-1])]
        asked = asked[:, np.concatenate([[True], (asked[:, 1:] != asked[:, :-1]).any(axis=0)])]
    kept: dict[int, list[np.ndarray]] = defaultdict(list)
    starts = np.flatnonzero(np.concatenate([[True], asked[0, 1:] != asked[0, :-1]])) if asked.shape[1] else np.empty(0, np.int64)
    for part in np.split(asked, starts[1:], axis=1) if len(starts) else []:
        t, text, shift = int(part[0, 0]), part[1], part[2]
        m, low, high = len(index.words[t]), low_of[text], high_of[text]
        band = 2 + m // 8
        own = np.zeros(index.base, bool)
        own[index.words[t]] = True
        near, far = np.clip(shift - band, low, high), np.clip(shift + m + band, low, high)
        a = int(near.min())
        some = np.concatenate([[0], np.cumsum(own[words[a : int(far.max())]])])
        kept[m].append(part[:, (some[far - a] - some[near - a]) / m >= least])  # words that could match
    for m, parts in kept.items():
        of, text, shift = np.concatenate(parts, axis=1)
        if len(of):
            yield m, of, text, shift


def scan_texts(texts: list[str | None], index: Index, least: float) -> list[list[tuple[str, float, int, int, int]]]:
    """Of each text (template, coverage, matched words, start, end) of every aligned occurrence of coverage >= least: code points, end exclusive; of overlapping ones of a template the best (more words, then earlier, then longer)."""
    out: list[list[tuple[str, float, int, int, int]]] = [[] for _ in texts]
    ids, ends = [], []
    for t in texts:
        ids += index.read(WORD.findall(t or ""))
        ends.append(len(ids))
    words, high_of = np.array(ids, np.int64), np.array(ends, np.int64)
    low_of = np.concatenate([[0], high_of[:-1]])
    asked = [np.empty((3, 0), np.int64)]  # template, text, diagonal
    for k, (codes, template, place) in index.posting.items():
        grams = index.codes(words, k)
        lo, hi = np.searchsorted(codes, grams, "left"), np.searchsorted(codes, grams, "right")
        hit = np.flatnonzero(hi > lo)
        hit = hit[hit + k <= high_of[np.searchsorted(high_of, hit, "right")]]
        sizes = hi[hit] - lo[hit]
        at = np.repeat(hit, sizes)
        row = np.repeat(lo[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(at))
        asked.append(np.stack([template[row], np.searchsorted(high_of, at, "right"), at - place[row]]))
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for m, of, text, shift in alike(index, np.concatenate(asked, axis=1), words, low_of, high_of, least):
        low, high, band, rows = low_of[text], high_of[text], 2 + m // 8, max(1, CELLS // (m + 4 * (2 + m // 8)))
        for a in range(0, len(text), rows):
            s = slice(a, a + rows)
            matched, first, end = align(np.stack([index.words[t] for t in of[s].tolist()]), words, low[s], high[s], shift[s], band)
            for i in np.flatnonzero((matched > 0) & (matched / m >= least)).tolist():
                found[int(text[s][i])].append((int(of[s][i]), int(matched[i]), int(first[i] - low[s][i]), int(end[i] - low[s][i])))
    for d, rows in found.items():
        spans = [x.span() for x in WORD.finditer(texts[d])]
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each template, sorted
        for t, matched, first, end in sorted(set(rows), key=lambda x: (x[0], -x[1], x[2], -x[3])):
            i = bisect_left(taken[t], (first, end))
            if (i == 0 or taken[t][i - 1][1] <= first) and (i == len(taken[t]) or taken[t][i][0] >= end):
                taken[t].insert(i, (first, end))
                out[d].append((index.names[t], matched / len(index.words[t]), matched, spans[first][0], spans[end - 1][1]))
        out[d].sort(key=lambda x: (x[3], x[0]))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", row_id: str = "doc_id", coverage: float = 0.8) -> DataFrame:
    """doc_id, template, coverage, matched, start, end for every match (templates: all_templates() unless given) in every row of docs; rows without a match give none.

    Passes without a shuffle: rows are judged on their own, so hot sources, repeated rows and ties need no care. Templates of any number are dealt into indexes of about INDEX_WORDS words, one pass each. Words are runs of letters, digits and _, lower-cased; the document's
    k-grams are all looked up, the templates' winnowed, so that every run of GRAM + WINNOW - 1 words in common is seen; every diagonal so found that holds enough of the template's words is aligned. Null and empty texts match nothing.
    Rows are worked on in chunks of about wordtable.CHUNK bytes, a longer text alone; alignments in parts of about CELLS cells. Null and repeated ids are kept as they are; other columns are ignored.
    """
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, template string, coverage double, matched int, start long, end long"

    def scan(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in chunks(whole, 1):
                    hits = scan_texts(batch.column(1).to_pylist(), index, coverage)
                    owner = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                    columns = list(zip(*[x for h in hits for x in h], strict=True)) or [[]] * 5
                    kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "template", "coverage", "matched", "start", "end"])

        return rows.mapInArrow(run, schema)

    passes = [scan(index) for index in build_indexes(all_templates() if templates is None else templates)]
    if not passes:
        return rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, passes)
