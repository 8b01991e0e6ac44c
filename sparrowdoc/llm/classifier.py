"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams are of one and two words, in two spellings: the words as they are, and their classes (case, digits, the
punctuation they end with, whether a word repeats the one before it). All are hashed to a fixed number of weights. A
text's score is the sigmoid of a sparse dot product: the mean weight of its n-grams of each spelling, scaled, and a bias.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import BASE, U64, Rolling, mix, small_batches, tidy, views, words

#: log2 of the number of weights: 1 MB of them is sent to the executors, whatever the input.
BITS = 18
#: Labelled documents that training reads at most, the smallest by a hash of the id; a bound on a sample, see fit().
MOST_LABELLED = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.6, 0.3, 1e-4, 1e-4
#: The scale of the two spellings.
SCALES = (12.0, 24.0)

UPPER, DIGIT, LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = DIGIT[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, row and value of each n-gram occurrence; a row's values of one spelling sum to its scale."""
    rows = len(offsets) - 1
    start, end, row = words(data, offsets)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    text = Rolling(data).slices(start, end)
    upper, digit, letter = (_before(t[data]) for t in (UPPER, DIGIT, LETTER))
    size = end - start
    letters = letter[end] - letter[start]
    capitals = upper[end] - upper[start]
    case = np.where(letters == 0, 3, np.where(capitals == 0, 0, np.where(capitals == letters, 2 - (letters == 1), 1)))
    tail = np.where(letter[end] - letter[end - 1] > 0, 0, data[end - 1].astype(np.int64))
    marks = np.minimum(size - letters - (digit[end] - digit[start]), 3)
    same = np.zeros(len(text), np.int64)
    same[1:] = (text[1:] == text[:-1]) & (row[1:] == row[:-1])
    shape = mix((case + 4 * np.minimum(digit[end] - digit[start], 3) + 16 * marks + 64 * same + 128 * tail + (1 << 20) * np.minimum(size // 6, 5)).astype(U64) + U64(77))
    pair = np.flatnonzero(row[1:] == row[:-1])
    index, of, value = [], [], []
    for salt, (keys, scale) in enumerate(zip((text, shape), SCALES, strict=True)):
        both = np.concatenate([mix(keys + U64(salt)), mix(mix(keys[pair]) * U64(BASE) + keys[pair + 1] + U64(salt + 10))])
        r = np.concatenate([row, row[pair]])
        index.append((both >> U64(64 - BITS)).astype(np.int64))
        of.append(r)
        value.append(scale / np.bincount(r, minlength=rows)[r])
    return np.concatenate(index), np.concatenate(of), np.concatenate(value)


def margins(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The dot product of each row, with the bias (the last weight)."""
    index, row, value = features(data, offsets)
    return np.bincount(row, weights[index] * value, minlength=len(offsets) - 1) + weights[-1]


class Leader:
    """Follow the regularised leader, one rate for each coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@tidy
def _train(batches):
    """(label, text) -> one row: the weights. Examples are kept as sparse rows, at most MOST_LABELLED of them."""
    examples = []
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for at, to, data, offsets in views(batch, 1):
            index, row, value = features(data, offsets)
            order = np.argsort(row, kind="stable")
            index, value, cuts = index[order], value[order], np.searchsorted(row[order], np.arange(to - at + 1))
            for i in range(to - at):
                own, where = np.unique(index[cuts[i] : cuts[i + 1]], return_inverse=True)
                total = np.bincount(where, value[cuts[i] : cuts[i + 1]], minlength=len(own))
                examples.append((labels[at + i], np.append(own, 1 << BITS).astype(np.int32), np.append(total, 1.0).astype(np.float32)))
    leader = Leader((1 << BITS) + 1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS if examples else 0):
        for i in order.permutation(len(examples)):
            leader.learn(examples[i][1], examples[i][2].astype(np.float64), examples[i][0])
    yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype(np.float32).tobytes()])], names=["weights"])


def fold(column: str):
    """The remainder that deals rows out to training and hold-out."""
    return F.crc32(F.col(column).cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> np.ndarray:
    """Weights learnt from the labels of rows outside the hold-out fold.

    Null labels and labels of null ids are passed over; an id labelled more than once has the smaller label, and an id
    with several rows is represented by one of them. Training reads at most `most` labelled ids, those first by a hash
    of the id, in one task. Without labels all weights are 0 and every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 1))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = known.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    # at most `most` rows of two numbers
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = chosen.select("label", "text", F.xxhash64("id").alias("o")).repartition(1).sortWithinPartitions("o").drop("o")
    learnt = rows.mapInArrow(_train, "weights binary").first()
    return np.frombuffer(learnt["weights"], np.float32) if learnt else np.zeros((1 << BITS) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with a last column `__score` (0 to 1): the likelihood of label 1 by the text alone. Null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    small_batches(docs.sparkSession)

    @tidy
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in views(batch, at):
                score = 1 / (1 + np.exp(-np.clip(margins(sent.value, data, offsets), -700, 700)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score)], names=[*names, "__score"])

    plain = docs.toDF(*names)  # names may clash
    fields = ", ".join(f"{n} {t.dataType.simpleString()}" for n, t in zip(names, plain.schema, strict=True))
    return plain.mapInArrow(run, f"{fields}, __score double").toDF(*docs.columns, "__score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted for each row of docs; see fit() and scored(). Repeated rows each have a row.

    The score of a text without words is the sigmoid of the bias. A null id is in no fold: held_out is false. Empty
    tables give no rows; extra columns are not read.
    """
    out = scored(docs.select(F.col(id_col), F.col(text_col)), fit(docs, labels, id_col, text_col, label_col), text_col)
    return out.select(F.col(id_col), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5, **names) -> DataFrame:
    """The rows of docs, unchanged, whose score is at least `least`."""
    out = scored(docs, fit(docs, labels, text_col=text_col, **names), text_col)
    kept = out.toDF(*[f"c{i}" for i in range(len(docs.columns))], "s").where(F.col("s") >= least).drop("s")
    return kept.toDF(*docs.columns)
