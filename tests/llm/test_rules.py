"""Rules against a plain version."""

import re
from collections import Counter, defaultdict

from sparrowdoc.llm.rules import cleaned, line_rules

DOCS = "doc_id long, text string, source string, n_words string, lines int"


def brute(rows, share=0.02, least=10):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip("\x20\t\n\x0b\f\r"))
    holds, hosts = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        hosts[s or ""].add(i)
        for line in (t or "").split("\n"):
            if words(line):
                holds[s or "", norm(line)].add(i)
    common = {k for k, v in holds.items() if len(v) >= least and len(v) > share * len(hosts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        w, ls = words(t), [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + d for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for d in range(5)}
        lost = sum(len(words(x)) for x in ls if (s or "", norm(x)) in common)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered), failed, not failed and len(w) - lost >= max(10, 0.5 * len(w)), lost))
    return sorted(out, key=str)


def same(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    assert sorted(map(tuple, line_rules(docs).collect()), key=str) == brute(rows)


def test_documents(spark, sf):
    same(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark):
    boiler = "Cookie Notice and some more words that are said here again"
    rows = [(i, f"  {boiler.upper() if i % 2 else boiler}\t\nown words {i} a b c d e f g h {i}\n\n", "h") for i in range(30)]
    rows += [(100 + i, f"{boiler}\nx{i}", None) for i in range(12)]
    rows += [(200, None, "h"), (201, "", "h"), (202, "\n \n", "h"), (203, "a b c d e " * 50_000, "h"), (204, "é ß\x0b\x0c# 😀\n" * 3, "h"), (None, "x y", "h"), (None, "x y", "h"), (5, "again", "h"), (5, "again", "h"), (206, "x" * 300_000, "h")]
    same(spark, rows)


def test_empty(spark):
    assert line_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_without_common_lines(spark, sf):
    boiler = "Cookie Notice and some more words"
    texts = [f"  {boiler.upper() if i % 2 else boiler}\t\n\n own words {i} a b c d é f g h {i}\n{boiler}" for i in range(30)]
    rows = [(i, f"{t} x" if i % 3 else t, "h") for i, t in enumerate(texts)] + [(40, f"{boiler}\nonly a few more", "h"), (50, texts[5] + " y", None), (None, texts[6], "h"), (41, None, "h")]
    rows += [(100_000 + r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip("\x20\t\n\x0b\f\r"))
    holds, hosts = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        hosts[s or ""].add(i)
        for line in (t or "").split("\n"):
            holds[s or "", norm(line)].add(i)
    common = {k for k, v in holds.items() if k[1] and len(v) >= 10 and len(v) > 0.02 * len(hosts[k[0]])}
    decided = {r[0]: r[7] for r in brute(rows)}
    kept = [r for r in rows if decided[r[0]]]
    want = [(i, "\n".join(x for x in t.split("\n") if (s or "", norm(x)) not in common), s) for i, t, s in kept]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    out = cleaned(docs)
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text, r.source) for r in out.collect()], key=str) == sorted(want, key=str)
    assert any((i, t, s) not in rows for i, t, s in want) and all(tuple(r)[3:] == ("x", 1) for r in out.collect())
