"""Periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least `times` periods and
`least` words, that no neighbouring word extends. For each period p the words at jp and (j+1)p are tested, a grid of n/p
probes, n log n over all periods. A run of `times` periods holds times-1 such pairs in a row; what has so many is extended to
both sides by chunks, until words p apart differ.

Periods go by octaves, [1, 2), [2, 4), [4, 8) and so on. No period divides another one of its octave, so that the probes of an
octave are independent, and grid points inside a run that a divisor of p has already found are skipped: there the run of p
is that run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import cut_out, numbered, small_batches, tidy, views, words

#: Words of a run at least, and periods of it at least.
LEAST, TIMES = 6, 4
#: Probes that are made at once, survivors that are extended at once, and cells of their chunks.
PROBES, SLICE, CELLS = 1 << 17, 4096, 1 << 18


def _same_until(ids: np.ndarray, at: np.ndarray, p: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """From each `at` on, in the direction of `step`: the first place whose word is not that p further on, or `limit`."""
    cur, live, width = at.copy(), np.arange(len(at)), 32
    while len(live):
        far = cur[live, None] + step * np.arange(width)
        inside = far < limit[live, None] if step > 0 else far > limit[live, None]
        far = np.where(inside, far, at[live, None])
        other = ~inside | (ids[far] != ids[far + p[live, None]])
        ends = other.any(axis=1)
        cur[live] += step * np.where(ends, other.argmax(axis=1), width)
        live = live[~ends]
        width = max(32, min(2 * width, CELLS // max(len(live), 1)))
    return cur


class Found:
    """Runs found so far (start, end, period), by start; and for each, which of those up to it reaches farthest."""

    def __init__(self):
        self.start = self.end = self.period = self.far = np.empty(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)  # of equal stretches the smallest period is the run's
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[new], end[new], period[new]
        most = np.maximum.accumulate(self.end) if len(self.end) else self.end
        self.far = np.maximum.accumulate(np.where(self.end == most, np.arange(len(most)), 0)) if len(most) else most

    def covers(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which grid points lie, with the one p further on, in a found run of a divisor of p that is p and its own period long."""
        out = np.zeros(len(at), bool)
        if len(self.start):
            last = np.searchsorted(self.start, at, side="right") - 1
            for i in (last, self.far[np.maximum(last, 0)]):
                i, ok = np.maximum(i, 0), last >= 0
                out |= ok & (self.start[i] <= at) & (at + p < self.end[i]) & (p % self.period[i] == 0) & (self.end[i] - self.start[i] >= p + self.period[i])
        return out


def runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs, by start, end; ids are the words of texts one after another, text i's from first[i] on."""
    n, found, octave, row = np.diff(first), Found(), 1, times - 1
    most = int(n.max(initial=0))
    while octave * times <= most:
        texts = np.flatnonzero(n >= max(octave * times, least))
        width = np.minimum(2 * octave - 1, n[texts] // times) - octave + 1
        text = np.repeat(texts, width)
        p = octave + np.arange(len(text)) - np.repeat(np.cumsum(width) - width, width)
        probes = np.concatenate([[0], np.cumsum((n[text] - 1) // p)])
        done, fresh = 0, []
        while done < len(text):
            to = max(done + 1, int(np.searchsorted(probes, probes[done] + PROBES, side="right")) - 1)
            count = np.diff(probes[done : to + 1])
            pair = np.repeat(np.arange(done, to), count)
            at = first[text[pair]] + (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * p[pair]
            hit = ids[at] == ids[at + p[pair]]
            size = len(hit) - row + 1
            if size > 0:
                held = pair[:size] == pair[row - 1 :]
                for i in range(row):
                    held &= hit[i : i + size]
                x = np.flatnonzero(held)
                x = x[~found.covers(at[x], p[pair[x]])]
                fresh += _extended(ids, first, text, p, pair[x], at[x], x, least, times)
            done = to
        if fresh:
            found.add(*(np.concatenate(c) for c in zip(*fresh, strict=True)))
        octave *= 2
    return found.start, found.end, found.period


def _extended(ids, first, text, p, pair, at, probe, least, times) -> list:
    """Runs around surviving grid points. Points in a row are taken up from the first; those that its run covers are skipped."""
    out = []
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = (probe[1:] != probe[:-1] + 1) | (pair[1:] != pair[:-1])
        head = np.flatnonzero(new)
        until = np.empty(len(head), np.int64)
        for a in range(0, len(head), SLICE):
            x = head[a : a + SLICE]
            period, own = p[pair[x]], text[pair[x]]
            until[a : a + SLICE] = end = _same_until(ids, at[x], period, first[own + 1] - period, 1)
            start = _same_until(ids, at[x], period, first[own] - 1, -1) + 1
            good = end + period - start >= np.maximum(least, times * period)
            out.append((start[good], (end + period)[good], period[good]))
        left = at > np.repeat(until, np.diff(np.append(head, len(at))))
        pair, at, probe = pair[left], at[left], probe[left]
    return out


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of each of n rows, joined by one space."""
    gap = np.zeros(len(start), np.int64)
    gap[1:] = row[1:] == row[:-1]
    size = end - start
    place = np.repeat(np.cumsum(gap), size) + np.arange(int(size.sum()))
    out = np.full(len(place) + int(gap.sum()), 0x20, np.uint8)
    out[place] = np.frombuffer(cut_out(data, start, end).buffers()[2], np.uint8)[: len(place)] if len(place) else 0
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, weights=size + gap, minlength=n).astype(np.int64), out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int, times: int):
    @tidy
    def run(batches):
        """(doc, text) -> doc, n_words, runs, collapsed."""
        for batch in batches:
            for a, b, data, offsets in views(batch, 1):
                start, end, row = words(data, offsets)
                ids, _ = numbered(cut_out(data, start, end))
                first = np.searchsorted(row, np.arange(b - a + 1))
                s, e, q = runs(ids, first, least, times)
                order = np.lexsort((q, s))
                s, e, q = s[order], e[order], q[order]
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, e, -1)
                kept = np.cumsum(gone[:-1]) == 0
                of = np.searchsorted(first, s, side="right") - 1
                cuts = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(q)], fields=list(RUNS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), items), _joined(data, start[kept], end[kept], row[kept], b - a)],
                    names=["doc", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period), collapsed, for each row of docs.

    Words are runs of characters other than space and \\t..\\r, numbered from 0. collapsed: the words, joined by one space, without
    those that any run holds after its first period. Null and empty texts have no words and no runs; null ids stay null, and rows
    with equal ids each have their own row. Texts of any length are taken whole, each in one task. Other columns are not read; an
    empty table gives no rows.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(_found(least, times), f"doc {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("doc", id_col)
