"""Periodic runs against a plain version."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from sparrowdoc.llm import periodic, q12_periodic
from sparrowdoc.llm.periodic import periodic_runs, runs


def brute(w, least=6, times=4):
    """All runs (start, length, period), by every period and place."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed):
    r = random.Random(seed)
    for _ in range(60):
        w = []
        while len(w) < r.randint(0, 120):
            kind = r.random()
            if kind < 0.5:
                unit = [r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(1, 12))]
                w += (unit * 12)[: r.randint(1, len(unit) * 9)]
            else:
                w += [r.choice("ab") if kind < 0.8 else str(r.random()) for _ in range(r.randint(1, 20))]
        yield w


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (9, 3)])
def test_runs(least, times):
    for seed in range(8):
        own = list(texts(seed))
        first = np.concatenate([[0], np.cumsum([len(w) for w in own])])
        flat = [x for w in own for x in w]
        ids = np.array([sorted(set(flat)).index(x) for x in flat], np.int64)
        s, e, q = runs(ids, first, least, times)
        at = np.searchsorted(first, s, side="right") - 1
        got = sorted(zip(at.tolist(), (s - first[at]).tolist(), (e - s).tolist(), q.tolist()))
        assert got == sorted((i, *r) for i, w in enumerate(own) for r in brute(w, least, times))


def test_small_blocks(monkeypatch):
    """Blocks of probes and survivors change nothing."""
    ids = np.array([x for w in texts(3) for x in map(hash, w)], np.int64)
    first = np.array([0, len(ids)])
    whole = [x.tolist() for x in runs(ids, first)]
    for name, n in (("PROBES", 50), ("SLICE", 3), ("CELLS", 64)):
        monkeypatch.setattr(periodic, name, n)
    assert [x.tolist() for x in runs(ids, first)] == whole


def rows_of(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_words int").repartition(parts)
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 100_000), (5, "long word " * 50_000), (5, "a b c " * 4), (5, "a b c " * 4), (None, "x y x y x y x y"), (6, "é 😀\x0b" * 9), (7, "w" * 300_000), (8, "\x1fa a a a a a a a\x00"), (9, " ".join(map(str, range(20_000))))]
    want = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        found = brute(w) if len(w) < 1000 else [(0, len(w), len(set(w)))] if i != 9 else []
        want.append((i, len(w), found, collapsed(w, found)))
    assert rows_of(spark, rows) == sorted(want, key=str)
    assert rows_of(spark, []) == []
    with pytest.raises(ValueError):
        periodic_runs(spark.range(1), "id", "id", times=1)


def test_query(spark, sf, tmp_path):
    """Digests of the query, planted texts too, with nulls and repeated ids among them."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(None, "a b " * 9), (900_001, None), (900_002, ""), (10**18, "c " * 70)] + [(10**9 + i, "one two three four five six seven eight nine ten " * 5) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h = 1 if i is None else crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        found = brute(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(w, found))))
    assert sorted(map(tuple, q12_periodic.query(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
