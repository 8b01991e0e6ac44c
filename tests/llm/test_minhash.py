"""Near duplicates against all pairs, and the signature's statistics."""

from collections import Counter

import numpy as np
import pytest

from sparrowdoc.llm.minhash import bag_signatures, deduplicated, near_duplicates

DOCS = "doc_id long, text string, class_id string, n int"


def bag(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())


def brute(rows, least=0.8):
    """Union-find over all pairs of distinct texts that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    bags, of = [bag(t) for t in texts], {}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in enumerate(bags):
        near = Counter()
        for s in b:
            for j in of.get(s, ()):
                near[j] += 1
            of.setdefault(s, []).append(i)
        for j in near:
            both = sum((b & bags[j]).values())
            if both / (b.total() + bags[j].total() - both) >= least:
                parent[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for i, t in rows:
        r = at[t or ""]
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return sorted((i, first.get(at[t or ""])) for i, t in rows)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    element = rng.integers(0, 2**52, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = bag_signatures(np.tile(element, 2), np.repeat([0, 1], 60), np.concatenate([a, b]), 2, 4096)
    assert abs((both[0] == both[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5
    assert np.isfinite(both).all()


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.class_id) for r in near_duplicates(docs).collect())
    assert got == brute(rows)
    assert any(i != c for i, c in got)


def test_a_large_group_of_edits(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 4)):
            words[at] = f"x{rng.integers(1_000_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.integers(10**6)}" for _ in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()) == brute(rows)


def test_a_template_just_below_the_threshold(spark):
    """A template of 40 parts of 10 words; each text has three inner parts, no two side by side, of words of its own. Two texts
    are at most at 0.77 to each other, but the 40 pairs with the same parts replaced, which share nothing but the template, at 0.808."""
    rng, seen, rows = np.random.default_rng(11), set(), []
    while len(rows) < 1000:
        parts = tuple(sorted(rng.choice(np.arange(1, 39), 3, replace=False)))
        if parts in seen or min(np.diff(parts)) < 2:
            continue
        seen.add(parts)
        for _ in range(2 if len(rows) < 80 else 1):
            rows.append((len(rows), " ".join(f"x{len(rows)}_{k}" if k // 10 in parts else f"w{k}" for k in range(400))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()) == [(i, i - i % 2 if i < 80 else i) for i in range(1000)]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "a  b"), (6, long), (7, long + " end"), (7, long + " end"), (None, "a b"), (None, None), (9, "é ü ß à ö"), (10, "é ü ß à ö x")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], DOCS)
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_duplicates(docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 3), (7, 6, 3), (9, 9, 1)} <= got
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 6, 9, 10]


def test_one_row_for_each_class_where_ids_repeat(spark):
    """Id 1 has two unrelated texts; id 2 has a copy of the first and a text of its own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(*r, "c", 1) for r in [(1, a), (1, b), (2, a + " more"), (2, c), (3, c), (1, a)]], DOCS)
    assert sorted((r.doc_id, r.text) for r in deduplicated(docs).collect()) == [(1, a), (1, b), (2, c)]


@pytest.mark.parametrize("f", [near_duplicates, deduplicated])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0
