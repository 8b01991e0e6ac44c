"""License scans by a positional index of notices' words, looked up by the rarest of them.

Notices are short texts with a label and phrases that must be there. Their index files each word under the notices and
positions that have it. A first reading of the documents counts in how many the words of the index occur, which gives their
weights: 1 + floor(1000 ln((N+1)/(df+1))). A second one does this for each document:

1. Notices of whose weight the document's words could not cover COVER percent, or that need a word it does not have, are out.
2. Of each other notice, the rarest words of its key phrases (SEEDS of them, all of which a document must have) are looked up: an
   occurrence at word i that the notice needs at t proposes that the notice begins at i-t. Postings are intersected by this
   relative position: all seeds must agree.
3. There the whole notice is compared, word by word. It is found if all its key phrases stand where they should and the words
   that agree have at least COVER of its weight.

Plain phrases are notices that are key phrases as a whole. A place that passes 3 passes 1 and 2 as well, so that none is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import LOWER, cut_out, small_batches, tidy, views, words

#: Words of a notice that are looked up; share of a notice's weight, in percent, that must agree; places that are compared at once.
SEEDS, COVER, BLOCK = 4, 60, 4096

INK = np.zeros(256, bool)
INK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def split(text: str) -> list[str]:
    """Words of a lower-cased (A-Z) text: runs of digits, a-z and characters outside ASCII."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words(data, np.array([0, len(data)]), INK[data])
    return [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]


@dataclass(frozen=True)
class Notice:
    """A label, the text that speaks for it, and phrases of the text that must be there; without any, all of it must."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[str]:
        return split(self.text)

    def needed(self) -> list[int]:
        """Positions of the words of all key phrases."""
        own, at = self.words(), set()
        for phrase in map(split, self.phrases or (self.text,)):
            where = [i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase]
            if not where or not phrase:
                raise ValueError(f"{phrase} is no phrase of the notice of {self.label}")
            at.update(range(where[0], where[0] + len(phrase)))
        return sorted(at)


#: Phrases of which each place is reported.
BASE = (
    Notice("gpl", "gnu general public license", base=True),
    Notice("apache", "apache license", base=True),
    Notice("cc-by", "cc by", base=True),
    Notice("mit", "mit license", base=True),
)

_LESSER, _GPL, _AGPL = "GNU Lesser General Public License", "GNU General Public License", "GNU Affero General Public License"
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, {}"


def _gnu(label: str, name: str, version: str) -> list[Notice]:
    key = f"{name}, version {version}"
    return [
        Notice(label, f"This work is licensed under the {key}", (key,)),
        Notice(label, _FREE.format(name, f"either version {version} of the License, or (at your option) any later version"), (name, f"version {version} of the License")),
        Notice(label, _FREE.format(name, f"version {version} of the License"), (name, f"version {version} of the License")),
    ]


def _creative(label: str, short: str, long: str) -> list[Notice]:
    return [
        Notice(label, f"Licensed under CC {short} 4.0", (f"CC {short} 4.0",)),
        Notice(label, f"This work is licensed under a Creative Commons {long} 4.0 International License", (f"Creative Commons {long} 4.0",)),
        Notice(label, f"creativecommons.org/licenses/{short}/4.0"),
    ]


#: Notices of common licenses; version numbers are words of their own.
NOTICES = (
    *_gnu("gpl-2.0", _GPL, "2"), *_gnu("gpl-3.0", _GPL, "3"), *_gnu("lgpl-2.1", _LESSER, "2.1"), *_gnu("lgpl-3.0", _LESSER, "3"), *_gnu("agpl-3.0", _AGPL, "3"),
    *_creative("cc-by-4.0", "BY", "Attribution"), *_creative("cc-by-nc-4.0", "BY-NC", "Attribution-NonCommercial"), *_creative("cc-by-sa-4.0", "BY-SA", "Attribution-ShareAlike"),
    *_creative("cc-by-nd-4.0", "BY-ND", "Attribution-NoDerivatives"), *_creative("cc-by-nc-sa-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    Notice("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache.org/licenses/LICENSE-2.0",)),
    Notice("apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", ("AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "specific language governing permissions and limitations")),
    Notice("mit", "Released under the MIT License", ("MIT License",)),
    Notice("mit", "Licensed under the MIT License", ("MIT License",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("Permission is hereby granted, free of charge", "to deal in the Software without restriction")),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Notice("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Notice("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0", ("Mozilla Public License, version 2.0",)),
    Notice("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("Eclipse Public License 2.0",)),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("Permission to use, copy, modify", "with or without fee is hereby granted")),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Notice("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Notice("cc0-1.0", "CC0 1.0 Universal"),
    Notice("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("Boost Software License, Version 1.0",)),
    Notice("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("In no event will the authors be held liable",)),
)
#: Licenses that a file may name by a tag.
TAGGED = ("apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "epl-2.0", "isc", "cc0-1.0", "bsl-1.0", "zlib")
TAGS = tuple(Notice(label, f"SPDX-License-Identifier: {label}") for label in TAGGED)
ALL = (*BASE, *NOTICES, *TAGS)


class Index:
    """Words of the notices by number, and for each notice its words, needed positions and postings."""

    def __init__(self, notices: tuple[Notice, ...]):
        own = [n.words() for n in notices]
        self.notices, self.vocabulary = notices, sorted({w for ws in own for w in ws}, key=str.encode)
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([number[w] for w in ws]) for ws in own]
        self.needed = [np.array(n.needed()) for n in notices]
        self.values = pa.array([w.encode() for w in self.vocabulary], pa.large_binary())

    @staticmethod
    @cache
    def of(notices: tuple[Notice, ...]) -> Index:
        return Index(notices)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words data[start:end]; those that no notice has get one past the last."""
        found = pc.index_in(cut_out(data, start, end), value_set=self.values)
        return pc.fill_null(found, len(self.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)


def _present(index: Index, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(index.vocabulary) + 1), bool)
    out[row, ids] = True
    return out[:, :-1]


def _counted(notices: tuple[Notice, ...]):
    def run(batches):
        """One row for the texts (word -1), and one for each word's texts."""
        index = Index.of(notices)
        df, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for a, b, data, offsets in views(batch, 0):
                data = LOWER[data]
                start, end, row = words(data, offsets, INK[data])
                df += _present(index, index.ids(data, start, end), row, b - a).sum(axis=0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.append(n, df))], names=["word", "df"])

    return run


def weights(texts: DataFrame, notices: tuple[Notice, ...] = ALL) -> np.ndarray:
    """Weight of each word of the index, from all texts (text); as many rows reach the driver as the notices have words."""
    rows = texts.mapInArrow(_counted(notices), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(Index.of(notices).vocabulary) + 1, np.int64)
    df[rows.column("word").to_numpy() + 1] = rows.column("df").to_numpy()
    return 1 + np.floor(1000 * np.log((df[0] + 1) / (df[1:] + 1))).astype(np.int64)


def places(index: Index, weight: np.ndarray, ids: np.ndarray, first: np.ndarray, seeds: int = SEEDS, cover: int = COVER):
    """(notice, text, word where it begins, weight that agrees, whole weight) of the notices found in texts, whose words are
    ids[first[i]:first[i+1]]. A notice whose head is cut off may begin before its text."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    present = _present(index, ids, row, n)
    for k, own in enumerate(index.words):
        whole, distinct = int(weight[own].sum()), np.unique(own)
        holds = np.bincount(np.searchsorted(distinct, own), weights=weight[own]).astype(np.int64)
        needed = own[index.needed[k]]
        seed = np.unique(needed)
        seed = seed[np.lexsort((seed, -weight[seed]))][:seeds]  # the rarest first; numbers are in order of the words
        texts = np.flatnonzero((100 * (present[:, distinct] @ holds) >= cover * whole) & present[:, needed].all(axis=1))
        if not len(texts):
            continue
        chosen = np.zeros(n, bool)
        chosen[texts] = True
        is_seed = np.zeros(len(index.vocabulary) + 1, bool)
        is_seed[seed] = True
        at = np.flatnonzero(is_seed[ids] & chosen[row])
        # postings of a word: the needed positions that have it
        by_word = index.needed[k][np.argsort(needed, kind="stable")]
        lo, hi = np.searchsorted(own[by_word], ids[at]), np.searchsorted(own[by_word], ids[at], side="right")
        hit = np.repeat(at, hi - lo)
        t = by_word[np.repeat(lo, hi - lo) + np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        begin, of, word = hit - t, row[hit], ids[hit]
        order = np.lexsort((word, begin, of))
        begin, of, word = begin[order], of[order], word[order]
        new = np.ones(len(begin), bool)
        new[1:] = (of[1:] != of[:-1]) | (begin[1:] != begin[:-1])
        fresh = new.copy()
        fresh[1:] |= word[1:] != word[:-1]
        head = np.flatnonzero(new)
        agree = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
        good = head[agree == len(seed)]
        for a in range(0, len(good), BLOCK):
            b, x = begin[good[a : a + BLOCK]], of[good[a : a + BLOCK]]
            far = b[:, None] + np.arange(len(own))
            inside = (far >= first[x][:, None]) & (far < first[x + 1][:, None])
            same = inside & (ids[np.where(inside, far, 0)] == own)
            got = same @ weight[own]
            ok = same[:, index.needed[k]].all(axis=1) & (100 * got >= cover * whole)
            if ok.any():
                yield k, x[ok], b[ok] - first[x[ok]], got[ok], whole


FOUND = "label string, base boolean, word int, words int, start int, end int, score double"


def _scanned(notices: tuple[Notice, ...], weight: np.ndarray, seeds: int, cover: int):
    @tidy
    def run(batches):
        """(doc, text) -> doc, n_words, found."""
        index = Index.of(notices)
        for batch in batches:
            for a, b, data, offsets in views(batch, 1):
                data = LOWER[data]
                start, end, row = words(data, offsets, INK[data])
                first = np.searchsorted(row, np.arange(b - a + 1))
                hits = [(np.full(len(x), k), x, at, got, np.full(len(x), whole)) for k, x, at, got, whole in places(index, weight, index.ids(data, start, end), first, seeds, cover)]
                k, x, at, got, whole = (np.concatenate(c) for c in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64),) * 5
                order = np.lexsort((k, at, x))
                k, x, at, got, whole = (c[order] for c in (k, x, at, got, whole))
                size = np.array([len(w) for w in index.words])[k]
                before = np.zeros(len(data) + 1, np.int64)  # characters before a byte
                np.cumsum((data & 0xC0) != 0x80, out=before[1:])
                from_, to = start[np.maximum(first[x] + at, first[x])] if len(x) else x, end[np.minimum(first[x] + at + size, first[x + 1]) - 1] if len(x) else x
                base = before[offsets[x]]
                columns = [
                    pa.array([index.notices[i].label for i in k], pa.string()), pa.array([index.notices[i].base for i in k], pa.bool_()), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array((before[from_] - base).astype(np.int32)), pa.array((before[to] - base).astype(np.int32)), pa.array(got / np.maximum(whole, 1)),
                ]
                items = pa.StructArray.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])
                cuts = pa.array(np.searchsorted(x, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(cuts, items)], names=["doc", "n_words", "found"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = ALL, seeds: int = SEEDS, cover: int = COVER) -> DataFrame:
    """id, n_words, found for each row of docs. found: an array of label, base (a plain phrase), word (where the notice begins,
    from 0; below it if its head is cut off), words (of the notice), start, end (characters of the text, end exclusive), score
    (the share of the notice's weight that agrees), by word.

    Every place of every notice is found; the same words may speak for several. A notice with words put in or left out
    inside is found by the part on one side of the gap, if that has its phrases and `cover` percent of its weight. Null and
    empty texts have no words; null ids stay null; rows with equal ids each have their own row. Other columns are not read. An
    empty table gives no rows. Starts a job for the words' counts when called.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    weight = weights(rows.select("text"), notices)
    kind = rows.schema["doc"].dataType.simpleString()
    fields = ",".join(":".join(c.split()) for c in FOUND.split(", "))
    return rows.mapInArrow(_scanned(notices, weight, seeds, cover), f"doc {kind}, n_words long, found array<struct<{fields}>>").withColumnRenamed("doc", id_col)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = ALL) -> DataFrame:
    """id, labels (distinct, sorted array) of docs, of all rows; see find_licenses()."""
    found = find_licenses(docs, id_col, text_col, notices)
    return found.select(id_col, F.array_sort(F.array_distinct(F.transform("found", lambda f: f["label"]))).alias("labels"))
