"""The pipeline's stages against plain versions, each on its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_minhash import brute as near_brute  # noqa: E402
from test_pii import base  # noqa: E402
from test_suffix import brute as repeat_brute  # noqa: E402

from sparrowdoc.llm.classifier import classify  # noqa: E402


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        before = outs[-1] if outs else docs
        stage(spark, before.coalesce(2), sf).write.parquet(str(tmp_path / name))
        outs.append(spark.read.parquet(str(tmp_path / name)))
        if name != "sequences":
            assert outs[-1].columns == docs.columns
    good, single, unique, clean, packed = outs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert sorted(rows(good)) == sorted((i, t) for i, t in rows(docs) if i in {r.doc_id for r in classify(docs, labels).where("predicted = 1").collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in near_brute(rows(good))})
    repeats = repeat_brute(rows(single))
    removed, wordy = {r[0]: r[2] for r in repeats}, {r[0]: r[5] for r in repeats}
    texts = dict(rows(single))
    for i, t in rows(unique):
        gone = len(texts[i].encode()) - len(t.encode())
        assert gone >= removed[i] - 12 and (gone <= removed[i] or wordy[i])
    before = dict(rows(unique))
    for i, t in rows(clean):
        assert not [s for s in base(t)]
        assert t == before[i] or "[" in t
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows(clean)}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_whole(spark, sf, tmp_path):
    """run() over documents with nulls, repeated ids, copies, shared passages and personal data: its pieces hold, token by token,
    what the stages leave one after another."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    passage = " ".join(f"shared{i}" for i in range(60))
    kind = dict(documents.dtypes)["doc_id"]
    odd = [(None, "no id but words " * 20), (900_001, None), (900_002, ""), (900_005, "reach me@x.org or 1.2.3.4"), (900_005, "reach me@x.org or 1.2.3.4"), (900_006, "long word " * 30_000)]
    # a passage in six long texts that have nothing else in common
    good = classify(documents, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").select("doc_id")
    long = documents.where("n_chars > 1500").join(good, "doc_id").dropDuplicates(["text"]).orderBy("doc_id").limit(6).collect()
    odd += [(910_000 + i, f"{r.text[::-1]}\n{passage}\n{r.text[::-1]}" if i % 2 else f"{r.text}\n{passage}") for i, r in enumerate(long)]
    more = spark.createDataFrame([(*r, "en", None, None) for r in odd], f"doc_id {kind}, text string, lang string, source string, n_chars long")
    both = documents.unionByName(more.select(*(more[c].cast(t).alias(c) for c, t in documents.dtypes))).withColumn("root", documents["doc_id"] * 0)
    both = both.withColumn("class_id", both["lang"]).withColumn("spans", both["text"])
    both.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == both.columns
        docs.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert docs.count() <= before.count()
        holders = [d for d, t in rows(docs) if passage in (t or "")]
        assert len(holders) >= 2 if i < 2 else not holders
    left = sorted(rows(docs), key=str)
    assert not [s for _, t in left for s in base(t or "")]
    assert sum(i == 900_005 for i, _ in left) <= 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want, got = {}, {}
    for i, t in left:
        want[i] = want.get(i, 0) + len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
