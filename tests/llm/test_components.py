"""Classes of links, in one go and link by link, and the steps that it takes to find them."""

import numpy as np

from sparrowdoc.llm import minhash
from sparrowdoc.llm.common import Scratch, components, merged


def plain(links):
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return sorted(root.items())


def table(spark, scratch, links):
    return scratch.keep(spark.createDataFrame(links, "a long, b long"))


def found(df):
    return sorted((r.id, r.root) for r in df.collect())


def test_stars_are_classes_at_once(spark):
    """Each step writes a table of many partitions: stars need one step, and none to see that nothing changes any more."""
    scratch = Scratch(spark)
    links = table(spark, scratch, [(10 * i, 10 * i + j) for i in range(5) for j in range(1, 8)])
    before = scratch.count
    assert found(components(scratch, links)) == sorted((10 * i + j, 10 * i) for i in range(5) for j in range(8))
    assert scratch.count - before == 1


def test_random_links_in_three_parts(spark):
    rng, scratch = np.random.default_rng(8), Scratch(spark)
    links = [tuple(map(int, x)) for x in rng.permutation(200)[rng.integers(0, 200, (150, 2))] if x[0] != x[1]] + [(i, i + 1) for i in range(1000, 1030)]
    rng.shuffle(links)
    parts = [[tuple(map(int, x)) for x in links[i::3]] for i in range(3)]
    assert found(components(scratch, table(spark, scratch, sum(parts, [])))) == plain(links)
    roots = scratch.keep(components(scratch, table(spark, scratch, parts[0])))
    for part in parts[1:]:
        roots = merged(scratch, roots, table(spark, scratch, part))
    assert found(roots) == plain(links)


def test_no_links(spark):
    scratch = Scratch(spark)
    none = components(scratch, table(spark, scratch, []))
    assert found(none) == []
    assert found(merged(scratch, scratch.keep(none), table(spark, scratch, [(5, 2)]))) == [(2, 2), (5, 2)]


def test_texts_are_looked_up_once(spark, monkeypatch):
    """A template with texts just below the threshold keeps buckets open over all rounds; the candidates' texts are written in the first."""
    looked, written = [], []
    monkeypatch.setattr(minhash, "hashed_set", lambda df, column, f=minhash.hashed_set: looked.append(column) or f(df, column))
    monkeypatch.setattr(minhash.Scratch, "keep", lambda self, df, f=Scratch.keep: written.append("text" in df.columns) or f(self, df))
    rows = [(i, " ".join(f"x{i}_{k}" if k in range(3 * i + 10, 3 * i + 22) else f"w{k}" for k in range(150))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({r.class_id for r in minhash.near_duplicates(docs).collect()}) == 40
    assert len(looked) == 1 and sum(written) == 1
