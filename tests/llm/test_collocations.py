"""Collocations against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparrowdoc.llm import collocations as C


def brute(rows, max_n=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    longer = Counter()
    for (lang, p), a in f.items():
        if a >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and not 100 * longer[lang, p] >= cover * a:
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, s, a, p, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -s))
    return ranked


def mined(spark, rows, parts=5, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, a int").repartition(parts)
    return sorted(map(tuple, C.collocations(docs, **options).collect()))


def made(seed=1, n=300):
    r = random.Random(seed)
    common = ["the", "of", "The", "a", "É", "x\x01y", "|", "ab", "abc"]
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 60)):
            w += r.choice([["new", "york", "city"], ["new", "york"], [r.choice(common)], [f"rare{r.random()}"], [r.choice("qrs")], ["a", "\tof", " the"]])
            w += r.choice(["", "", "", "", ".", "\n", ",,", "\x0b", "\r", ";", "!", "?", ":"])
        yield r.choice(["en", "en", "de", None, "und", "", "a b", "a\tb", "%20 %\t"]), " ".join(w).replace(" .", r.choice([".", " ."]))


ODD = [("en", None), ("en", ""), ("en", " \t.\n"), (None, None), ("fr", "w " * 50_000), ("en", "z" * 300_000), ("de", "the " * 12 + "a" * 70_000 + " b")]


@pytest.mark.parametrize("options", [{}, {"max_n": 2, "least": 3}, {"max_n": 5, "least": 2, "top": 7, "cover": 90}, {"least": 1, "cover": 20}])
def test_made(spark, options):
    rows = [*made(), *made()][:420] + ODD
    assert mined(spark, rows, **options) == sorted(brute(rows, **options))


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, ODD[:4]) == []
    with pytest.raises(ValueError):
        mined(spark, [], max_n=1)


def test_hot_words(spark):
    """Nearly every suffix begins with one of two words: their parts are added up."""
    r = random.Random(5)
    rows = [("en", " ".join(r.choice(["hot", "hot", "warm", f"w{r.randint(0, 40)}"]) for _ in range(80))) for _ in range(150)]
    assert mined(spark, rows, parts=9) == sorted(brute(rows))


def test_stack_in_blocks():
    """Rows pushed in blocks of any size give the counts of all at once."""
    r = random.Random(2)
    rows = sorted(((r.choice(["de\t", "en\t", "en\t\t"]) + "".join(r.choice("ab") * r.randint(1, 2) + " " for _ in range(r.randint(2, 4))), r.randint(1, 3)) for _ in range(500)), reverse=True)
    want = Counter()
    for s, c in rows:
        w = s.split(" ")[:-1]
        for k in range(2, len(w) + 1):
            want[" ".join(w[:k]) + " "] += c
    for block in (1, 2, 7, 500):
        stack, found = C.Stack(4), []
        for i in range(0, len(rows), block):
            s, c = zip(*rows[i : i + block])
            found += stack.push(pa.array(s), np.array(c))
        found += stack.close()
        got = [(p.decode(), c) for prefix, _, count in found for p, c in zip(prefix.to_pylist(), count.tolist())]
        assert len(dict(got)) == len(got) and dict(got) == want
        assert all(p.count(b" ") == k for prefix, k, _ in found for p in prefix.to_pylist())


def test_large_numbers():
    """Numbers of suffixes that pass 62 bits are made small on the way."""
    r = random.Random(3)
    ids = np.array([r.choice([1, 2, 3]) for _ in range(2000)])
    every, last = np.ones(2000, bool), np.arange(2000) < 1999
    small, large = C.suffixes(ids, last, every, 5), C.suffixes(np.where(ids == 3, 1 << 40, ids), last, every, 5)
    assert sorted(zip(*(x.tolist() for x in small))) == sorted(zip(*(x.tolist() for x in large)))
