"""Removal of long repeated passages by suffix arrays in a logarithmic index family.

A passage is a string of LENGTH bytes that starts at two places or more, in one document or several; strings of SHORT bytes
are followed beside it, for passages that are counted in words. Each window of SHORT bytes is filed under its anchor: of the
GRAM-byte strings in it, the first one of the smallest hash. Equal windows have equal anchors at equal distances, so that only
suffixes that start at anchors need an index, about one in 105 bytes. An anchor's context is the bytes of its windows, each
carried on to LENGTH bytes or to its text's end.

The index is a family of levels, each a written table of the different contexts of some batches, sorted by anchor. A
batch of texts is added so:

1. Its anchors are counted, and merge-scanned against all levels by anchor. A context that occurs twice repeats as a
   whole. One whose anchor has no second occurrence can be in no match.
2. The bytes of the other contexts meet under their anchor: its suffixes are sorted to a suffix array in runs, whose sizes
   double as they merge; each merge scans neighbours for their common prefix. A suffix's longest one bounds the windows
   that can repeat, and within that bound equal windows are told by a hash of all their bytes.
3. The batch becomes a level, unless it is the last. Levels of equal height merge to one of the next, so that n batches leave
   log n levels.

Spans found are of old texts as well as new ones. Classes of more than CLASS contexts are not gathered in a task: their windows
are counted as rows, each by itself.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.llm.common import BASE, SPACE, U64, Rolling, Scratch, hashed_set, in_set, mix, small_batches, tidy, views, words

LENGTH, SHORT, GRAM = 400, 256, 48
#: A passage that is counted in words has more than so many.
WORDS = 50
#: Batches in which a whole table is added.
BATCHES = 2
#: Contexts of a class that one task takes at most (about 0.6 KB each), of a block, and of a run of suffixes.
CLASS, BLOCK, RUN = 20_000, 4096, 1024
#: Windows whose hashes are held at a time.
WINDOWS = 250_000

LOW = U64(0xFFFFFFFF)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by minima from both ends of blocks."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, short: int = SHORT, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each anchor: row, pos, first and last window (lo, hi), end of its context (to), hashes of the anchor (k) and of the
    context (c). Equal contexts in a row, as in periodic text, are one entry: times, and the last one's hi and to as far and
    end. Positions are the data's."""
    names = ("row", "pos", "lo", "hi", "to", "far", "end", "times")
    none = {n: np.empty(0, np.int64) for n in names} | {"k": np.empty(0, U64), "c": np.empty(0, U64)}
    if len(data) < short:
        return none
    roll = Rolling(data)
    hashes = roll.windows(gram)
    least = sliding_min((hashes & ~LOW) | np.arange(len(hashes), dtype=U64), short - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + short <= offsets[row + 1])
    if not len(window):
        return none
    anchor = (least[window] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    lo, hi, pos = window[first], window[np.append(first[1:], len(window)) - 1], anchor[first]
    row = row[lo]
    to = np.minimum(hi + length, offsets[row + 1])
    k = hashes[pos]
    c = mix(mix(roll.slices(lo, to) + (pos - lo).astype(U64) * U64(BASE)) + (hi - lo).astype(U64))
    new = np.ones(len(lo), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(lo)) - 1
    return {"row": row[at], "pos": pos[at], "lo": lo[at], "hi": hi[at], "to": to[at], "far": hi[last], "end": to[last], "times": last - at + 1, "k": k[at], "c": c[at]}


ANCHORS = "h1 long, h2 long, pos int, lo int, hi int, to int, far int, end int, times long, k long, c long"


@tidy
def _anchors(batches):
    """(h1, h2, text) -> rows of ANCHORS; positions are the text's."""
    for batch in batches:
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, _, data, offsets in views(batch, 2):
            x = anchored(data, offsets)
            base = offsets[x["row"]]
            places = [(x[n] - base).astype(np.int32) for n in ("pos", "lo", "hi", "to", "far", "end")]
            columns = [h1[at + x["row"]], h2[at + x["row"]], *places, x["times"], x["k"].view(np.int64), x["c"].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ANCHORS.split(", ")])


CONTEXTS = (("k", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("lo", pa.int32()), ("left", pa.int32()), ("windows", pa.int32()), ("open", pa.bool_()), ("bytes", pa.binary()))


@tidy
def _cut(batches):
    """(h1, h2, text, asked) -> the contexts asked for, as CONTEXTS."""

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), CONTEXTS, strict=True)], names=[n for n, _ in CONTEXTS])

    for batch in batches:
        out = []
        for i in range(len(batch)):
            text = memoryview(batch.column(2)[i].as_buffer())
            h1, h2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for x in batch.column(3)[i].as_py():
                out.append((x["k"], h1, h2, x["lo"], x["pos"] - x["lo"], x["hi"] - x["lo"] + 1, x["open"], bytes(text[x["lo"] : x["to"]])))
                if len(out) == 4000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)


class Family:
    """Suffix arrays whose sizes double: a new run is a level of its own, and levels of equal size merge.

    Suffixes are rows of a matrix, filled up with zeros; a level is their indices in order. reach is the longest common
    prefix of a suffix with any other that its level holds.
    """

    def __init__(self, suffixes: np.ndarray):
        self.rows = suffixes
        self.keys = suffixes.view(f"S{suffixes.shape[1]}").ravel()
        self.reach = np.zeros(len(suffixes), np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []

    def scan(self, order: np.ndarray) -> None:
        for at in range(0, len(order) - 1, 8192):
            a, b = order[at : at + 8192][: len(order) - 1 - at], order[at + 1 : at + 8193]
            same = self.rows[a] == self.rows[b]
            prefix = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
            np.maximum.at(self.reach, a, prefix)
            np.maximum.at(self.reach, b, prefix)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[a], self.keys[b], side="right") + np.arange(len(b))
        out = np.empty(len(a) + len(b), np.int64)
        rest = np.ones(len(out), bool)
        rest[at] = False
        out[at], out[rest] = b, a
        self.scan(out)
        return out

    def add(self, start: int, end: int) -> None:
        order = start + np.argsort(self.keys[start:end], kind="stable")
        self.scan(order)
        height = 0
        while self.levels and self.levels[-1][0] == height:
            order = self.merged(self.levels.pop()[1], order)
            height += 1
        self.levels.append((height, order))

    def whole(self) -> np.ndarray:
        """One array of all suffixes; their reach is then final."""
        while len(self.levels) > 1:
            (_, b), (h, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((h + 1, self.merged(a, b)))
        return self.levels[0][1] if self.levels else np.empty(0, np.int64)


def repeats(k: np.ndarray, left: np.ndarray, windows: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray, lengths: tuple[int, ...] = (SHORT, LENGTH), run: int = RUN, most: int = WINDOWS):
    """For each length: entries and window numbers (from the context's start) of windows that repeat among the entries, which
    are sorted by k.

    An entry's context is data[begin:begin+size], its anchor at `left` in it; `windows` start in it, of each length those
    that end in it.
    """
    n, longest = len(k), max(lengths)
    suffixes = np.zeros((n, longest), np.uint8)
    span = np.minimum(size - left, longest)
    row = np.repeat(np.arange(n), span)
    col = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
    suffixes[row, col] = data[begin[row] + left[row] + col]
    family = Family(suffixes)
    for at in range(0, n, run):
        family.add(at, min(n, at + run))
    family.whole()
    roll = Rolling(data)
    cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if n else np.zeros(1, np.int64)
    found = []
    for length in lengths:
        # window j begins `left - j` before the anchor, and needs a common prefix of length - left + j
        count = np.clip(np.minimum(np.minimum(windows, size - length + 1), family.reach - length + left + 1), 0, None)
        entries, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def counted(entry: np.ndarray, j: np.ndarray, length: int = length, entries: list = entries, numbers: list = numbers) -> None:
            start = begin[entry] + j
            hashes = roll.slices(start, start + length)
            order = np.sort(hashes)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if len(twice):
                at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
                hit = twice[at] == hashes
                entries.append(entry[hit])
                numbers.append(j[hit])

        total = np.concatenate([[0], np.cumsum(count)])[cuts]
        i = 0
        while i + 1 < len(cuts):
            to = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
            at, end = cuts[i], cuts[to]
            if total[to] - total[i] <= most:
                c = count[at:end]
                entry = np.repeat(np.arange(at, end), c)
                counted(entry, np.arange(len(entry)) - np.repeat(np.cumsum(c) - c, c))
            else:  # one class: by distance from the window's start to the anchor, since equal windows have it equal
                step = max(1, most // int(end - at))
                for a in range(0, int(left[at:end].max()) + 1, step):
                    entry, j = [], []
                    for d in range(a, a + step):
                        x = np.flatnonzero((left[at:end] - d >= 0) & (left[at:end] - d < count[at:end])) + at
                        entry.append(x)
                        j.append(left[x] - d)
                    counted(np.concatenate(entry), np.concatenate(j))
            i = to
        entry, j = np.concatenate(entries), np.concatenate(numbers)
        order = np.lexsort((j, entry))
        found.append((entry[order], j[order]))
    return found


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; offsets begin at 0."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


SPANS = "h1 long, h2 long, a int, b int, long boolean"


def _spans(table: pa.Table, entry: np.ndarray, j: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of repeating windows as spans of their documents."""
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entry))[: len(first)] - 1
    e = entry[first]
    lo = table.column("lo").to_numpy()[e]
    columns = [table.column("h1").to_numpy()[e], table.column("h2").to_numpy()[e], (lo + j[first]).astype(np.int32), (lo + j[last] + length).astype(np.int32), np.full(len(e), length == LENGTH)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h1", "h2", "a", "b", "long"])


def _resolved(block: int = BLOCK):
    @tidy
    def run(batches):
        """Contexts sorted by k -> spans of the open ones; blocks end where k changes."""

        def blocks():
            held, rows = [], 0
            for batch in batches:
                k = batch.column(0).to_numpy()
                if held and rows >= block and len(k) and k[0] != held[-1].column(0)[-1].as_py():
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                at = 0
                for cut in (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist():
                    if rows + cut - at >= block:
                        held.append(batch.slice(at, cut - at))
                        yield pa.Table.from_batches(held)
                        held, rows, at = [], 0, cut
                if at < len(batch):
                    held.append(batch.slice(at))
                    rows += len(batch) - at
            if held:
                yield pa.Table.from_batches(held)

        for table in blocks():
            data, offsets = _flat(table.column("bytes"))
            numbers = [table.column(c).to_numpy().astype(np.int64) for c in ("k", "left", "windows")]
            open_ = table.column("open").to_numpy()
            for length, (entry, j) in zip((SHORT, LENGTH), repeats(*numbers, np.diff(offsets), data, offsets[:-1]), strict=True):
                yield _spans(table, entry[open_[entry]], j[open_[entry]], length)

    return run


def _windows(batches):
    """Contexts -> each of their windows: hash of its bytes, and where it is if it is open."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = pa.Table.from_batches([batch.slice(at, 512)])
            data, offsets = _flat(part.column("bytes"))
            roll, open_ = Rolling(data), part.column("open").to_numpy()
            for length in (SHORT, LENGTH):
                count = np.clip(np.minimum(part.column("windows").to_numpy(), np.diff(offsets) - length + 1), 0, None)
                entry = np.repeat(np.arange(len(part)), count)
                start = offsets[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
                a = part.column("lo").to_numpy()[entry] + (start - offsets[entry])
                columns = [roll.slices(start, start + length).view(np.int64), part.column("h1").to_numpy()[entry], part.column("h2").to_numpy()[entry], a.astype(np.int32), np.full(len(entry), length == LENGTH), open_[entry]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "h1", "h2", "a", "long", "open"])


def _filtered(bits, inside: bool, column: int):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_set(bits.value, batch.column(column).to_numpy()) == inside))

    return run


def _keys(text) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


class Index:
    """The family of levels over the texts added so far. Texts are (h1, h2, text), once or more for each text.

    A level has a row for each different context of its batches: k, c, its occurrences n, and one of them (first).
    """

    def __init__(self, spark: SparkSession, most_in_class: int = CLASS):
        self.spark, self.scratch, self.most = spark, Scratch(spark), most_in_class
        self.levels: list[tuple[int, DataFrame]] = []
        self.texts: list[DataFrame] = []
        self.found: list[DataFrame] = []
        small_batches(spark)

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """Adds a batch; SPANS of what repeats in it, or between it and what was here, in old texts too. Written.

        last: no batch comes after it, so that it need not become a level.
        """
        scratch, place = self.scratch, F.struct("h1", "h2", "pos", "lo", "hi", "to", "far", "end")
        self.texts.append(texts)
        anchors = scratch.keep(texts.mapInArrow(_anchors, ANCHORS))
        new = anchors.groupBy("k", "c").agg(F.sum("times").alias("n"), F.min(place).alias("first"))
        new = scratch.keep(new.sortWithinPartitions("k"))
        here = new.withColumn("fresh", F.lit(True))
        for _, level in self.levels:
            here = here.union(level.withColumn("fresh", F.lit(False)))
        # the scan: contexts of all levels by anchor. Old contexts that had no copy may get one now
        met = here.repartition("k").groupBy("k", "c").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("fresh").alias("fresh"), F.collect_set(F.when(~F.col("fresh") & (F.col("n") == 1), F.col("first"))).alias("old")
        )
        classes = met.groupBy("k").agg(F.sum("n").alias("total"), F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("open"), F.max("fresh").alias("asks")).where("total > 1 and asks")
        shared = scratch.keep(met.join(classes.drop("total", "asks"), "k"))
        again = shared.where("n > 1 and fresh")
        old = again.select(F.explode("old").alias("o")).select("o.*")
        where = ["h1", "h2", "lo", "far", "end"]
        whole = anchors.join(again.select("k", "c"), ["k", "c"]).select(*where).union(old.select(*where))
        spans = [
            whole.select("h1", "h2", F.col("lo").alias("a"), (F.col("far") + SHORT).alias("b"), F.lit(False).alias("long")),
            whole.where(F.col("lo") + LENGTH <= F.col("end")).select("h1", "h2", F.col("lo").alias("a"), F.col("end").alias("b"), F.lit(True).alias("long")),
        ]
        unlike = shared.where("m > 1 and open > 0").select("k", "m", (F.col("n") == 1).alias("open"), "first.*")
        entry = F.struct("k", "pos", "lo", "hi", "to", "open", (F.col("m") > self.most).alias("large"))
        asked = scratch.keep(unlike.groupBy("h1", "h2").agg(F.collect_list(entry).alias("asked")))
        bits = self.spark.sparkContext.broadcast(hashed_set(asked, "h1"))
        every = reduce(DataFrame.union, self.texts)
        some = every.mapInArrow(_filtered(bits, True, 0), "h1 long, h2 long, text string").groupBy("h1", "h2").agg(F.first("text").alias("text"))
        found = "k long, h1 long, h2 long, lo int, left int, windows int, open boolean, bytes binary"

        def cut(which: bool) -> DataFrame:
            own = asked.select("h1", "h2", F.filter("asked", lambda x: x["large"] == which).alias("asked")).where(F.size("asked") > 0)
            return some.join(own, ["h1", "h2"]).select("h1", "h2", "text", "asked").mapInArrow(_cut, found)

        spans.append(cut(False).repartition("k").sortWithinPartitions("k").mapInArrow(_resolved(), SPANS))
        if not unlike.where(F.col("m") > self.most).isEmpty():
            windows = scratch.keep(cut(True).mapInArrow(_windows, "g long, h1 long, h2 long, a int, long boolean, open boolean"))
            often = windows.groupBy("g", "long").agg(F.count("*").alias("t")).where("t > 1")
            size = F.when(F.col("long"), F.lit(LENGTH)).otherwise(F.lit(SHORT))
            spans.append(windows.where("open").join(often, ["g", "long"]).select("h1", "h2", "a", (F.col("a") + size).alias("b"), "long"))
        self.found.append(scratch.keep(reduce(DataFrame.union, spans)))
        if last:
            self.levels = []
        else:
            self._raised(new)
        scratch.close(*self.found, *(level for _, level in self.levels))
        bits.unpersist()
        return self.found[-1]

    def _raised(self, level: DataFrame) -> None:
        """The new level; levels of equal height merge, and the merged one is written as they were."""
        height = 0
        while self.levels and self.levels[-1][0] == height:
            own = self.levels.pop()[1].union(level).groupBy("k", "c").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
            level, height = self.scratch.keep(own.sortWithinPartitions("k")), height + 1
        self.levels.append((height, level))


def repeated_spans(texts: DataFrame, most_in_class: int = CLASS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, text), once or more for each text -> (h1, h2, spans) of the texts with repeats, spans as
    array<struct<a,b,long>> of byte positions: strings of LENGTH bytes that repeat are long, those of SHORT bytes not."""
    index = Index(texts.sparkSession, most_in_class)
    for i in range(batches):
        index.add(texts.where(F.pmod("h2", F.lit(batches)) == i), last=i + 1 == batches)
    spans = reduce(DataFrame.union, index.found).groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b", "long")).alias("spans"))
    out = index.scratch.keep(spans)
    index.scratch.close(out)
    return out


def joined(spans) -> list[tuple[int, int]]:
    """Maximal runs of what spans (a, b) cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs(spans: list, raw) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What strings of LENGTH bytes cover; and what those of SHORT bytes cover, if it has more than WORDS whole words."""
    long = joined((s["a"], s["b"]) for s in spans if s["long"])
    data, wordy = np.frombuffer(raw, np.uint8), []
    for a, b in joined((s["a"], s["b"]) for s in spans):
        n = len(words(data[a:b], np.array([0, b - a]))[0])
        # words that an end of the run cuts are not whole
        n -= int(a > 0 and not SPACE[data[a - 1 : a + 1]].any()) + int(b < len(data) and not SPACE[data[b - 1 : b + 1]].any())
        if n > WORDS:
            wordy.append((a, b))
    return long, wordy


@tidy
def _digest(batches):
    """(doc, text, spans) -> doc, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""
    for batch in batches:
        out = []
        texts, spans = batch.column(1), batch.column(2)
        for i in range(len(batch)):
            text = texts[i].as_buffer()
            raw = memoryview(text) if text is not None else memoryview(b"")
            own, wordy = runs(spans[i].as_py() or [], raw)
            left, at = hashlib.sha256(), 0
            for a, b in own:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in own), len(own), left.hexdigest(), len(wordy)))
        if out:
            n, removed, count, sha, passages = zip(*out, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])


def _with_spans(rows: DataFrame, text: str, carried: list[str], most_in_class: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """rows, with columns h1 and h2 first -> those that no span touches, and those that may have some, with `spans`."""
    spans = repeated_spans(rows.select("h1", "h2", text), most_in_class, batches)
    bits = rows.sparkSession.sparkContext.broadcast(hashed_set(spans, "h1"))
    schema = rows.select("h1", "h2", *carried).schema
    pick = rows.select("h1", "h2", *carried)
    free = pick.mapInArrow(_filtered(bits, False, 0), schema)
    touched = pick.mapInArrow(_filtered(bits, True, 0), schema).join(spans, ["h1", "h2"], "left")
    return free, touched


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_class: int = CLASS, batches: int = BATCHES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for each row of docs.

    Texts are UTF-8 bytes, null is empty. A byte is removed if a string of LENGTH bytes that covers it starts anywhere
    else in docs, the same row included. n_passages: maximal runs of bytes that strings of SHORT bytes cover so, with more
    than WORDS whole words in them. Copies and repeated rows repeat each other. Null ids stay null; other columns are
    not read; an empty table gives no rows.

    The table is added to an index in `batches` batches, whose number does not change the result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text")).select(*_keys("text"), "doc", "text")
    free, touched = _with_spans(rows, "text", ["doc", "text"], most_in_class, batches)
    kind = rows.schema["doc"].dataType.simpleString()
    found = touched.select("doc", "text", "spans").mapInArrow(_digest, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
    zero = F.lit(0).cast("long")
    plain = free.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), zero.alias("n_passages"))
    return plain.union(found).withColumnRenamed("doc", id_col)


def _removed(at: int, names: list[str]):
    def run(batches):
        """The text at column `at` without the passages of the last column; a character that one cuts stays whole."""
        for batch in batches:
            texts, spans, out = batch.column(at), batch.column(len(names)), []
            for i in range(len(batch)):
                text, own = texts[i].as_py(), spans[i].as_py()
                if not text or not own:
                    out.append(text)
                    continue
                raw, kept, start = text.encode(), [], 0
                for a, b in joined(x for found in runs(own, raw) for x in found):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[start:a])
                    start = b
                out.append(b"".join([*kept, raw[start:]]).decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame, text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with the repeated passages taken out of the text, all other columns as they are; null texts stay null.

    A passage is a string of LENGTH bytes that repeats, or a run of repeated strings of SHORT bytes with more than WORDS
    words. Where one begins or ends inside a character, the character stays, so that texts are whole characters. An
    empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    rows = plain.select(*_keys(F.coalesce(names[at], F.lit(""))), "*")
    free, touched = _with_spans(rows, names[at], names, CLASS, batches)
    out = touched.select(*names, "spans").mapInArrow(_removed(at, names), plain.schema)
    return free.select(*names).union(out).toDF(*docs.columns)
