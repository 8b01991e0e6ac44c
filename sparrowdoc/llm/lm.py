"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are a text's words, A-Z lower-cased, and one end. The most frequent tokens (HEAD of them) are dealt by rank into
classes of equal size, and all others are one more class:

    p(w | h) = p(class(w) | h) * p(w | class(w), h)

Both factors are softmaxes over sums of weights of hashed features of the history h: the last token, the last two as a
bigram, the one before the last alone (a skip), and a bias. Inside the class of all others the pairs of all training texts
count: with b the bucket of the last token, c(b, w) how often w followed there and c(b) how often any of the others did,

    p(w | the others, h) = (max(c(b, w), 1) - 1) / c(b) + pairs(b) / c(b) * share(w)

where pairs(b) is the number of different pairs of b and share(w) is w's smoothed share of the training counts of the others
(absolute discounting by 1), so that the model is proper for tokens it has never seen.

Counts are exact, over all training rows. The weights are learnt in rounds: each task follows the gradient over the training
texts it reads and returns its steps, and these are averaged. Every training text is read in one of the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import BASE, LOWER, U64, Rolling, Scratch, hashed_set, in_set, mix, small_batches, tidy, views, words

#: Tokens with weights of their own, and classes of them.
HEAD, CLASSES = 1024, 32
SIZE = HEAD // CLASSES
#: log2 of the hashed feature rows of either softmax.
BITS = 13
#: log2 of the buckets of last tokens in whose pairs tokens of the rest are counted; 1 MB of sums whatever the input.
LAST = 16
#: log2 of the bits that tell the pairs of known tokens: 8 MB whatever the input.
PAIR_BITS = 26
#: Tokens whose counts are sent to all tasks: 3 MB whatever the input; the counts of the rest are joined.
KNOWN = 1 << 18
ROUNDS, RATE, BATCH = 2, 0.2, 2048
#: Tokens (8 bytes each) that a task holds before it sums them up.
COUNTED = 4_000_000
SMOOTH = 0.1
#: Bytes of text that are worked on at once; a gradient step does not reach over their end.
LM_BYTES = 1 << 20
END = np.array([0x656E64206F662074], U64)  # the end's hash; words have hashes of at least one byte

SCALE = np.log10(np.e)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token, a row's end after its words."""
    rows = len(offsets) - 1
    start, end, row = words(data, offsets)
    hashes = Rolling(LOWER[data]).slices(start, end)
    at = np.arange(len(hashes)) + row  # one end for each row before
    out, of = np.empty(len(hashes) + rows, U64), np.empty(len(hashes) + rows, np.int64)
    out[at], of[at] = hashes, row
    ends = np.cumsum(np.bincount(row, minlength=rows) + 1) - 1
    out[ends], of[ends] = END, np.arange(rows)
    return out, of


def training(column: str):
    """Rows to learn from: the remainder of the id's check sum is not 0; rows without an id are learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 10 != 0, F.lit(True))


@tidy
def _count(batches):
    """(text) -> (token, count), summed over runs of COUNTED tokens."""

    def summed(held):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "c"])

    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in views(batch, 0, LM_BYTES):
            held.append(tokens(data, offsets)[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield summed(held)
                held, size = [], 0
    if held:
        yield summed(held)


class Vocabulary:
    """The KNOWN most frequent tokens by hash, with counts and rank; a fixed size at most."""

    def __init__(self, token: np.ndarray, count: np.ndarray, total: int, distinct: int):
        order = np.lexsort((token, -count))
        rank = np.empty(len(token), np.int64)
        rank[order] = np.arange(len(token))
        by = np.argsort(token)
        self.token, self.count, self.rank = token[by], count[by], rank[by]
        self.total, self.distinct = total, distinct
        head = order[:HEAD]
        self.rest_total, self.rest_distinct = total - int(count[head].sum()), distinct - len(head)
        # for each bucket of last tokens: 1 / c(b), and what is left for the shares
        self.each, self.left = np.zeros(1 << LAST), np.ones(1 << LAST)

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (HEAD or more: no weights; -1: not here) and count."""
        if not len(self.token):
            return np.full(len(token), -1), np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        here = self.token[at] == token
        return np.where(here, self.rank[at], -1), np.where(here, self.count[at], 0)

    def in_head(self, token: np.ndarray) -> np.ndarray:
        head = self.token[self.rank < HEAD]
        return head[np.minimum(np.searchsorted(head, token), len(head) - 1)] == token if len(head) else np.zeros(len(token), bool)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all counts, and the tokens whose count is high enough that at most KNOWN have it."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # one row for each different count, and only from the top down to KNOWN tokens
    least, seen = 1 << 62, 0
    for r in counts.where("c > 1").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(KNOWN).collect():
        if seen + r.n > KNOWN:
            break
        least, seen = r.c, seen + r.n
    found = counts.where(F.col("c") >= least).toArrow()
    out = Vocabulary(found.column("token").to_numpy().view(U64), found.column("c").to_numpy(), total, distinct)
    out.least = least
    return out


def histories(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(tokens, 4) feature hashes of what stands before each token in its row."""
    one, two = np.zeros(len(token), U64), np.zeros(len(token), U64)
    same = row[1:] == row[:-1]
    one[1:][same] = token[:-1][same]
    same = row[2:] == row[:-2]
    two[2:][same] = token[:-2][same]
    return np.stack([mix(one + U64(1)), mix(mix(one + U64(2)) * U64(BASE) + two), mix(two + U64(3)), np.full(len(token), U64(BASE))], axis=1)


def pair(token: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of a token and the bucket of the one before it."""
    return mix(mix(token + U64(4)) * U64(BASE) + last.astype(U64))


PAIRS = "key long, last int, c long"


def _pairs(vocabulary):
    @tidy
    def run(batches):
        """(text) -> counts of the pairs of a token of the rest and the bucket of the one before, summed over runs of COUNTED tokens. A known
        token's pair has its hash as key, and the bucket as last; another one the token, and the bucket and 2^LAST; a bucket's own count has the
        bucket, and -1."""
        own, of = vocabulary.value, np.zeros(1 << LAST, np.int64)

        def batch_of(key, last, n):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(last.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "last", "c"])

        def summed(held):
            token, last = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at, n = np.unique(pair(token, last), return_index=True, return_counts=True)
            known = own.find(token[at])[0] >= 0
            return batch_of(np.where(known, key, token[at]), np.where(known, last[at], last[at] + (1 << LAST)), n)

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in views(batch, 0, LM_BYTES):
                token, row = tokens(data, offsets)
                rest = ~own.in_head(token)
                last = (histories(token, row)[rest, 0] >> U64(64 - LAST)).astype(np.int32)
                of += np.bincount(last, minlength=1 << LAST)
                held.append((token[rest], last))
                size += len(last)
                if size >= COUNTED:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)
        met = np.flatnonzero(of)
        yield batch_of(met, np.full(len(met), -1), of[met])

    return run


def remembered(texts: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> DataFrame:
    """The pairs that occur at least twice (PAIRS), a written table; the vocabulary gets the sums of each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)
    kept = scratch.keep(texts.mapInArrow(_pairs(sent), PAIRS).groupBy("key", "last").agg(F.sum("c").alias("c")).where("c > 1 or last < 0"))
    sent.unpersist()
    of = kept.where("last < 0").select("key", "c").toArrow()  # 2^LAST rows at most, here and below
    more = kept.where("last >= 0").groupBy((F.col("last") % (1 << LAST)).alias("b")).agg(F.sum(F.col("c") - 1).alias("c")).toArrow()
    total, again = np.zeros(1 << LAST), np.zeros(1 << LAST)
    total[of.column("key").to_numpy()] = of.column("c").to_numpy()
    again[more.column("b").to_numpy()] = more.column("c").to_numpy()
    vocabulary.each = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
    vocabulary.left = 1.0 - again * vocabulary.each
    return kept.where("last >= 0")


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def sums_of_runs(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """np.add.reduceat(x, cut) by rows, where most runs have one row or two."""
    size = np.diff(np.append(cut, len(x)))
    out = x.take(cut, axis=0)
    two, more = np.flatnonzero(size == 2), np.flatnonzero(size > 2)
    out[two] += x.take(cut[two] + 1, axis=0)
    if len(more):
        own = size[more]
        out[more] = np.add.reduceat(x.take(np.flatnonzero(np.repeat(size > 2, size)), axis=0), np.cumsum(own) - own, axis=0)
    return out


class Model:
    """Weights of both softmaxes: (features, classes and the rest) and (features, tokens of a class)."""

    def __init__(self, outer: np.ndarray | None = None, inner: np.ndarray | None = None):
        self.outer = np.zeros((1 << BITS, CLASSES + 1), np.float32) if outer is None else outer
        self.inner = np.zeros((1 << BITS, SIZE), np.float32) if inner is None else inner

    @staticmethod
    def features(history: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the outer weights, and of the inner ones, which are a class's own."""
        own = mix(history + (group.astype(U64) + U64(1))[:, None] * U64(0x9FB21C651E98DF25))
        return (history >> U64(64 - BITS)).astype(np.int64), (own >> U64(64 - BITS)).astype(np.int64)

    @staticmethod
    def summed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = weights.take(rows[:, 0], axis=0)
        for j in range(1, rows.shape[1]):
            out += weights.take(rows[:, j], axis=0)
        return out

    def logs(self, history: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Natural log of p(class) * p(token | class); for the rest of p(class) alone."""
        head = (rank >= 0) & (rank < HEAD)
        group = np.where(head, rank // SIZE, CLASSES)
        outer, _ = self.features(history, group)
        p = softmax(self.summed(self.outer, outer))
        out = np.log(p[np.arange(len(p)), group])
        if head.any():
            _, inner = self.features(history[head], group[head])
            p = softmax(self.summed(self.inner, inner))
            out[head] += np.log(p[np.arange(len(p)), rank[head] % SIZE])
        return out

    def start(self, rate: float) -> None:
        """Makes ready to learn: squares of past steps' gradients set each weight's own rate."""
        self.rate, self.past = rate, {id(w): np.full(w.shape, 1e-4, np.float32) for w in (self.outer, self.inner)}

    def step(self, history: np.ndarray, rank: np.ndarray) -> None:
        """One gradient step over a batch."""
        head = (rank >= 0) & (rank < HEAD)
        group = np.where(head, rank // SIZE, CLASSES)
        outer, _ = self.features(history, group)
        self._learn(self.outer, outer, group)
        if head.any():
            _, inner = self.features(history[head], group[head])
            self._learn(self.inner, inner, rank[head] % SIZE)

    def _learn(self, weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        g = softmax(self.summed(weights, rows))
        g[np.arange(len(g)), target] -= 1
        past = self.past[id(weights)]
        for j in range(rows.shape[1]):
            # texts have few different tokens before theirs, so that a batch sums up well by sorted feature
            order = np.argsort(rows[:, j].astype(np.uint16), kind="stable")
            own = rows[order, j]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at = own[cut]
            total = g.sum(axis=0, keepdims=True) if len(cut) == 1 else sums_of_runs(g.take(order, axis=0), cut)
            squares = past.take(at, axis=0)
            squares += total * total
            past[at] = squares
            np.sqrt(squares, out=squares)
            total /= squares
            total *= np.float32(self.rate)
            weights[at] = weights.take(at, axis=0) - total


WEIGHTS = "g long, n long, outer binary, inner binary"
#: Rows of weights (2 MB each) that one task averages.
FAN = 64


def _trained(vocabulary, model, rate):
    @tidy
    def run(batches):
        """(text) -> one row of weights after the texts of the task, and the tokens they were learnt from."""
        own, seen = Model(*(w.copy() for w in model.value)), 0
        own.start(rate)
        for batch in batches:
            for _, _, data, offsets in views(batch, 0, LM_BYTES):
                token, row = tokens(data, offsets)
                rank, _ = vocabulary.value.find(token)
                history = histories(token, row)
                for at in range(0, len(token), BATCH):
                    own.step(history[at : at + BATCH], rank[at : at + BATCH])
                seen += len(token)
        if seen:
            yield _weights(TaskContext.get().partitionId() // FAN, seen, own.outer, own.inner).to_batches()[0]

    return run


def _weights(group: int, n: int, outer: np.ndarray, inner: np.ndarray) -> pa.Table:
    columns = [pa.array([group]), pa.array([n]), pa.array([outer.astype(np.float32).tobytes()], pa.binary()), pa.array([inner.astype(np.float32).tobytes()], pa.binary())]
    return pa.table(columns, names=["g", "n", "outer", "inner"])


def _mean(rows) -> tuple[int, np.ndarray, np.ndarray]:
    """Mean of (n, outer, inner) by n; one row at a time."""
    total, outer, inner = 0, 0.0, 0.0
    for n, a, b in rows:
        total += n
        outer = outer + (np.frombuffer(a, np.float32) - outer) * np.float32(n / total)
        inner = inner + (np.frombuffer(b, np.float32) - inner) * np.float32(n / total)
    return total, outer, inner


def _averaged(key, table):
    rows = zip(table.column("n").to_pylist(), *([x.as_buffer() for x in table.column(c)] for c in ("outer", "inner")), strict=True)
    return _weights(key[0].as_py() // FAN, *_mean(rows))


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of gradient steps: round i reads the texts whose hash says so, all of them over the rounds.

    Two levels of means come before the driver: it takes one row for each FAN * FAN tasks.
    """
    context = texts.sparkSession.sparkContext
    known, model = context.broadcast(vocabulary), Model()
    for turn in range(rounds):
        sent = context.broadcast((model.outer, model.inner))
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).select("text")
        steps = own.mapInArrow(_trained(known, sent, RATE / (1 + turn)), WEIGHTS)
        steps = steps.groupBy("g").applyInArrow(_averaged, WEIGHTS).groupBy("g").applyInArrow(_averaged, WEIGHTS)
        total, outer, inner = _mean((r.n, r.outer, r.inner) for r in steps.collect())
        if total:
            model = Model(outer.reshape(1 << BITS, -1), inner.reshape(1 << BITS, -1))
        sent.unpersist()
    return model


#: kind: 0 is a text's row, 1 a token that is not known here, 2 a known one of the rest whose pair may be remembered.
PART = "id long, key long, kind int, last int, tf long, count long, n_tokens long, n_known long, base double, score double"


def _scored(vocabulary, model, pairs):
    @tidy
    def run(batches):
        """(doc, text) -> parts of its scores: one row for what is known here, and one for each other pair of the text."""
        known, own = vocabulary.value, Model(*model.value)
        rest = known.rest_total + SMOOTH * (known.rest_distinct + 1)
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to, data, offsets in views(batch, 1, LM_BYTES):
                rows = to - at
                token, row = tokens(data, offsets)
                rank, count = known.find(token)
                here, head = rank >= 0, (rank >= 0) & (rank < HEAD)
                logs = np.empty(len(token))
                history = histories(token, row)
                for i in range(0, len(token), BATCH):
                    logs[i : i + BATCH] = own.logs(history[i : i + BATCH], rank[i : i + BATCH])
                last = (history[:, 0] >> U64(64 - LAST)).astype(np.int32)
                key = pair(token, last)
                kind = np.where(here, 2, 1)
                kind[head] = 0
                kind[(kind == 2) & ~in_set(pairs.value, key)] = 0
                key[kind == 1] = token[kind == 1]
                share = np.where(here, np.log10(count + SMOOTH), 0.0)
                score = logs * SCALE
                alone = (kind == 0) & ~head
                score[alone] += share[alone] + np.log10(known.left[last[alone]] / rest)
                ids = np.arange(next_id, next_id + rows)
                next_id += rows
                # what is not settled here, once for each text, token and bucket
                other = np.flatnonzero(kind)
                order = other[np.lexsort((last[other], key[other], row[other]))]
                cut = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1]) | (last[order][1:] != last[order][:-1])])) if len(order) else np.empty(0, np.int64)
                one, more = order[cut], len(cut)
                zeros = np.zeros(more)
                doc = batch.column(0).slice(at, rows)
                columns = [
                    pa.concat_arrays([doc, pa.nulls(more, doc.type)]),
                    pa.array(np.concatenate([ids, ids[row[one]]])),
                    pa.array(np.concatenate([mix(ids.view(U64)), key[one]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(rows, np.int32), kind[one].astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(rows, np.int32), last[one]])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), np.diff(np.append(cut, len(order)))])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), count[one]])),
                    pa.array(np.concatenate([np.bincount(row, minlength=rows), zeros]).astype(np.int64)),
                    pa.array(np.concatenate([np.bincount(row[here], minlength=rows), zeros]).astype(np.int64)),
                    pa.array(np.concatenate([np.bincount(row, share, minlength=rows), zeros])),
                    pa.array(np.concatenate([np.bincount(row, score, minlength=rows), zeros])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", *(x.split()[0] for x in PART.split(", "))])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model and all counts come from the rows that are not held out (see training()); held_out rows are those whose
    check sum of the id has remainder 0. base_score is the smoothed unigram score, score the model's log10 probability of
    the text's tokens. Null and empty texts are one end. Repeated rows count, and are returned, each time; a null id is
    learnt from. Other columns are not read. An empty table gives no rows; if no row may be learnt from, all tokens
    are unknown and equally likely.
    """
    scratch, context = Scratch(docs.sparkSession), docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learnt = rows.where(training("doc")).select("text")
    counts = scratch.keep(learnt.mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    known = vocabulary(counts)
    model = train(learnt, known)
    kept = remembered(learnt, known, scratch)
    of_known = F.col("last") < 1 << LAST
    pairs = context.broadcast(hashed_set(kept.where(of_known), "key", PAIR_BITS))
    kind = rows.schema["doc"].dataType.simpleString()
    parts = rows.mapInArrow(_scored(context.broadcast(known), context.broadcast((model.outer, model.inner)), pairs), f"doc {kind}, {PART}")
    # a token that is not known has few pairs, fewer than `least`
    few = kept.where(~of_known).groupBy("key").agg(F.collect_list(F.struct((F.col("last") - (1 << LAST)).alias("last"), "c")).alias("pairs"))
    rare = counts.where(F.col("c") < known.least).select(F.col("token").alias("key"), "c").join(few, "key", "left")
    counted = rare.unionByName(kept.where(of_known).select("key", "c"), allowMissingColumns=True)
    buckets = pa.table({"last": np.arange(1 << LAST, dtype=np.int32), "each": known.each, "left": known.left / (known.rest_total + SMOOTH * (known.rest_distinct + 1))})
    new, found = F.col("kind") == 1, F.coalesce("c", F.lit(0))
    here = F.filter("pairs", lambda x: x["last"] == F.col("last"))
    again = F.when(new, F.coalesce(F.get(here, F.lit(0))["c"] - 1, F.lit(0))).otherwise(F.greatest(found - 1, F.lit(0)))
    count = F.when(new, found).otherwise(F.col("count")) + F.lit(SMOOTH)
    base = F.when(new, F.col("tf") * F.log10(count)).otherwise(0.0)
    part = F.when(F.col("kind") > 0, F.col("tf") * F.log10(again * F.col("each") + F.col("left") * count)).otherwise(0.0)
    joined = parts.join(counted, "key", "left").join(F.broadcast(docs.sparkSession.createDataFrame(buckets)), "last")
    joined = joined.select("doc", "id", "n_tokens", (F.col("n_known") + F.when(new & (found > 0), F.col("tf")).otherwise(0)).alias("n_known"), (F.col("base") + base).alias("base"), (F.col("score") + part).alias("score"))
    out = joined.groupBy("id").agg(F.max("doc").alias("doc"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    every = float(np.log10(known.total + SMOOTH * (known.distinct + 1)))
    return out.select(
        F.col("doc").alias(id_col), (~training("doc")).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * every).alias("base_score"), "score",
    )
