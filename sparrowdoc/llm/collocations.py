"""Phrase collocations by suffix sorting.

Texts are split into pieces at punctuation and line breaks, and these into words. Counts are by language, in two readings:

1. Words are counted. This gives the words of each language, those that are too rare to stand in a frequent phrase, and
   those that are hot, over 1/HOT of all words (so that they are HOT at most).
2. Each word starts a suffix, cut after max_n words, at its piece's end, or before a word that is too rare; one word alone is none.
   Equal suffixes of a run of texts are one row, of a key: the language, a tab, a second one if the first word is hot, and each
   word with a space behind it. Rows are dealt by language and first word and sorted downwards by key, so that a prefix stands
   in one stretch, behind the longer ones that begin with it; one stack of open prefixes counts all of them. A hot first
   word's suffixes are dealt by the words after it as well, into SALTS parts, whose counts are added up.

The parts of frequent phrases are then looked up among the counts: hot words in a broadcast table of HOT rows at most, all
others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.llm.common import BASE, LOWER, U64, Rolling, Scratch, cut_out, hashed_set, in_set, mix, numbered, small_batches, tidy, views, words

MAX_N, LEAST, TOP, COVER = 3, 10, 2000, 50
HOT, SALTS = 256, 64
#: Bytes of text whose suffixes are counted before they are dealt, and sorted rows that the stack takes up at once.
RUN, ROWS = 2 << 20, 1 << 16
UNKNOWN = "und"

BREAK = np.zeros(256, bool)
BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
BLANK = BREAK.copy()
BLANK[[0x20, 0x09]] = True
SPACE = 0x20


class Words:
    """The words of a run of texts in order: number (equal for equal words of one language), hash, is the next one in its piece."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        start, end, row = words(data, offsets, ~BLANK[data])
        self.slices = cut_out(data, start, end)
        ids, self.spelled = numbered(self.slices)
        lang, self.langs = numbered(langs.cast(pa.large_binary()))
        key, self.first, self.number, self.times = np.unique(lang[row] * max(len(self.spelled), 1) + ids, return_index=True, return_inverse=True, return_counts=True)
        self.lang, self.spelling = key // max(len(self.spelled), 1), key % max(len(self.spelled), 1)
        self.hashes = mix(_hashes(self.langs)[self.lang] * U64(BASE) + _hashes(self.spelled)[self.spelling])
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        self.linked = np.zeros(len(start), bool)
        self.linked[:-1] = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[start[:-1]])

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each with a space behind it, and where each begins."""
        offsets, data = (np.frombuffer(b, t) for b, t in zip(self.slices.buffers()[1:], (np.int64, np.uint8), strict=True))
        out = np.full(int(offsets[-1]) + len(self.slices), SPACE, np.uint8)
        out[np.arange(int(offsets[-1])) + np.repeat(np.arange(len(self.slices)), np.diff(offsets))] = data[: offsets[-1]]
        return out, offsets + np.arange(len(offsets))


def _hashes(values: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return Rolling(np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)).slices(offsets[:-1], offsets[1:])


def _read(batches) -> Iterator[Words]:
    """(lang, text) -> the words of runs of texts."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0), UNKNOWN)
        for a, b, data, offsets in views(batch, 1, RUN):
            yield Words(langs.slice(a, b - a), data, offsets)


@tidy
def _words(batches):
    """(lang, text) -> lang, word, h, c: the words of runs of texts."""
    for w in _read(batches):
        if len(w.first):
            names = [w.langs.take(pa.array(w.lang)).cast(pa.string()), w.spelled.take(pa.array(w.spelling)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*names, pa.array(w.hashes.view(np.int64)), pa.array(w.times)], names=["lang", "word", "h", "c"])


def suffixes(number: np.ndarray, linked: np.ndarray, kept: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first of each distinct suffix of two words or more, its words, and how often it occurs."""
    n, base = len(number), int(number.max(initial=0)) + 2
    step = linked & kept
    step[:-1] &= kept[1:]
    at = np.flatnonzero(step)
    key, bound, size, alive = number[at], base, np.ones(len(at), np.int64), np.ones(len(at), bool)
    for i in range(1, max_n):
        alive &= step[np.minimum(at + i - 1, n - 1)] & (at + i < n)
        if bound * base >= 1 << 62:
            key, bound = np.unique(key, return_inverse=True)[1], len(key) + 1
        key = key * base + np.where(alive, number[np.minimum(at + i, n - 1)] + 1, 0)
        bound *= base
        size += alive
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return at[first], size[first], times


def _escaped(lang: bytes) -> bytes:
    return lang.replace(b"%", b"%25").replace(b" ", b"%20").replace(b"\t", b"%09")


def _plain(lang: Column) -> Column:
    return F.replace(F.replace(F.replace(lang, F.lit("%20"), F.lit(" ")), F.lit("%09"), F.lit("\t")), F.lit("%25"), F.lit("%"))


def _dealt(max_n: int, bits, hot: np.ndarray):
    @tidy
    def run(batches):
        """(lang, text) -> g (what rows are dealt by), key, c."""
        for w in _read(batches):
            kept = in_set(bits.value, w.hashes)
            at, size, times = suffixes(w.number, w.linked, kept[w.number], max_n)
            if not len(at):
                continue
            data, begin = w.spaced()
            h = w.hashes[w.number]
            g, is_hot = h[at], np.isin(h[at], hot)
            rest = np.zeros(len(at), U64)
            for i in range(1, max_n):
                rest = mix(rest * U64(BASE) + np.where(i < size, h[np.minimum(at + i, len(h) - 1)], U64(0)))
            g = np.where(is_hot, mix(g + U64(1) + rest % U64(SALTS)), g)
            heads = [_escaped(x) + tabs for x in w.langs.to_pylist() for tabs in (b"\t", b"\t\t")]
            ends = np.cumsum([0, *map(len, heads)])
            head, before = 2 * w.lang[w.number[at]] + is_hot, int(ends[-1])
            bounds = [np.column_stack(x).ravel() for x in ((ends[head], before + begin[at]), (ends[head + 1], before + begin[at + size]))]
            both = cut_out(np.concatenate([np.frombuffer(b"".join(heads), np.uint8), data]), *bounds)
            offsets = np.ascontiguousarray(np.frombuffer(both.buffers()[1], np.int64)[::2])
            key = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), both.buffers()[2]]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), key, pa.array(times)], names=["g", "key", "c"])

    return run


def _large(batches, rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Stack:
    """Counts prefixes of two to max_n words of sorted keys; what is open at the end of a block of rows stays on the stack."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.open: dict[int, list] = {}  # number of words -> prefix, count

    def push(self, keys: pa.Array, c: np.ndarray) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        """(prefixes, words, counts) of the prefixes that end in these rows."""
        n, keys = len(c), keys.cast(pa.large_binary())
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + n + 1]
        data = np.frombuffer(keys.buffers()[2], np.uint8)
        space = np.flatnonzero(data == SPACE)
        before = np.searchsorted(space, offsets)  # spaces before a row
        size, has = np.diff(offsets), np.diff(before)
        # words that a row has in common with the one before it
        both = np.minimum(size[1:], size[:-1])
        row = np.repeat(np.arange(1, n), both)
        t = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
        other = np.flatnonzero(data[offsets[row] + t] != data[offsets[row - 1] + t])
        which, first = np.unique(row[other], return_index=True)
        same = np.append(0, both)
        same[which] = t[other[first]]
        common = np.searchsorted(space, offsets[:-1] + same) - before[:-1]
        head = keys[0].as_py()
        common[0] = max((k for k, own in self.open.items() if head.startswith(own[0])), default=0)
        total = np.concatenate([[0], np.cumsum(c)])
        for k in range(2, self.max_n + 1):
            cut = np.flatnonzero(common < k)
            until = np.append(cut[1:], n)
            if k in self.open and len(cut):
                prefix, count = self.open.pop(k)
                yield pa.array([prefix], pa.large_binary()), k, np.array([count + total[cut[0]]])
            elif k in self.open:
                self.open[k][1] += int(total[n])
            begins = has[cut] >= k
            at, to = cut[begins], until[begins]
            if len(at) and to[-1] == n:
                i = at[-1]
                self.open[k] = [data[offsets[i] : space[before[i] + k - 1] + 1].tobytes(), int(total[n] - total[i])]
                at, to = at[:-1], to[:-1]
            if len(at):
                yield cut_out(data, offsets[at], space[before[at] + k - 1] + 1), k, total[to] - total[at]

    def close(self) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        for k, (prefix, count) in self.open.items():
            yield pa.array([prefix], pa.large_binary()), k, np.array([count])


def _stacked(max_n: int, least: int):
    @tidy
    def run(batches):
        """Sorted (key, c) -> prefix, n_words, c: all prefixes, but those that are rare and whole."""

        def made(prefix, k, count):
            out = pa.RecordBatch.from_arrays([prefix.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(count), k, np.int32)), pa.array(count.astype(np.int64))], names=["prefix", "n_words", "c"])
            return out.filter(pc.or_(pc.greater_equal(out.column(2), least), pc.match_substring(out.column(0), "\t\t")))

        stack = Stack(max_n)
        for part in _large(batches, ROWS):
            for found in stack.push(part.column(0).combine_chunks(), part.column(1).to_numpy()):
                yield made(*found)
        for found in stack.close():
            yield made(*found)

    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame, list]:
    """Written tables of words (lang, word, h, c), all of them, and of phrases (lang, phrase, n_words, f) of 2 to max_n words that
    occur at least `least` times; and the hot words as (lang, word, count), HOT of them at most."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_words, "lang string, word string, h long, c long").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("c").alias("c"))
    own = scratch.keep(counted)
    total = own.agg(F.sum("c")).first()[0] or 0
    hot = own.where(F.col("c") > total / HOT).collect()  # HOT rows at most
    bits = docs.sparkSession.sparkContext.broadcast(hashed_set(own.where(F.col("c") >= least), "h"))
    dealt = rows.mapInArrow(_dealt(max_n, bits, np.array([r.h for r in hot], np.int64).view(U64)), "g long, key string, c long")
    ordered = dealt.repartition("g").sortWithinPartitions(F.desc("key")).select("key", "c")
    sums = ordered.mapInArrow(_stacked(max_n, least), "prefix string, n_words int, c long").groupBy("prefix", "n_words").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    lang, phrase = (F.substring_index("prefix", "\t", i) for i in (1, -1))
    phrases = scratch.keep(sums.select(_plain(lang).alias("lang"), F.rtrim(phrase).alias("phrase"), "n_words", "f"))
    bits.unpersist()
    return own, phrases, [(r.lang, r.word, r.c) for r in hot]


def _some(words_: Column, start, length) -> Column:
    return F.array_join(F.slice(words_, start, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = MAX_N, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score, a (both downwards) and phrase.

    Words are lower-cased (A-Z). A phrase of 2 to max_n words of one piece is a candidate if it occurs at least `least` times (a,
    overlaps included). Cut after k words, its parts occur l and r times; of all cuts the one of the lowest score
    floor(1000000 a a / (l r)) counts, the first of several. A candidate is dropped if a longer candidate holds it that occurs
    in `cover` percent of its places at least. n: words of the language.

    Numbers are exact (decimals of 38 digits: counts below 10^15). A null language is `und`; null and empty texts have no words;
    repeated rows count each; other columns are not read. An empty table gives no rows. Starts jobs when called.
    """
    if max_n < 2:
        raise ValueError("a phrase has two words at least")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    own, phrases, hot = phrase_counts(docs, scratch, lang_col, text_col, max_n, least)
    w = F.split("phrase", " ")
    # both parts of each cut, as 2k and 2k+1
    sides = lambda k: F.array(F.struct((2 * k).alias("s"), _some(w, F.lit(1), k).alias("part")), F.struct((2 * k + 1).alias("s"), _some(w, k + 1, F.col("n_words") - k).alias("part")))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), sides))
    asked = phrases.select("lang", "phrase", F.col("f").alias("a"), "n_words", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "n_words", "x.s", "x.part")
    few = F.broadcast(spark.createDataFrame(hot, "lang string, part string, hot_f long"))
    asked = asked.join(few, ["lang", "part"], "left")
    known = own.where(F.col("c") >= least).select("lang", F.col("word").alias("part"), F.col("c").alias("f"))
    known = known.union(phrases.where(F.col("n_words") < max_n).select("lang", F.col("phrase").alias("part"), "f"))
    found = asked.where("hot_f is not null").select("lang", "phrase", "a", "n_words", "s", F.col("hot_f").alias("f"))
    found = found.union(asked.where("hot_f is null").join(known, ["lang", "part"]).select("lang", "phrase", "a", "n_words", "s", "f"))
    # 2 (max_n - 1) numbers a phrase
    parts = found.groupBy("lang", "phrase", "a", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("s", "f"))).alias("f"))
    big = lambda c: c.cast("decimal(19,0)")
    wide = lambda c: c.cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        left, right = F.element_at("f", 2 * k), F.element_at("f", 2 * k + 1)
        score = F.call_function("div", wide(big(F.col("a")) * big(F.col("a"))) * F.lit(1_000_000).cast("decimal(7,0)"), wide(big(left) * big(right)))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    scored = parts.select("lang", "phrase", "a", "n_words", F.array_min(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), cut)).alias("b"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: _some(w, i, m))))
    held = phrases.where("n_words > 2").select("lang", F.explode(within).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * cover))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sizes = own.groupBy("lang").agg(F.sum("c").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
