"""Canonical JSON against Python's."""

import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from sparrowdoc.operators import provenance


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return {str(k): plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x


def dumped(x):
    return json.dumps(plain(x), ensure_ascii=False, sort_keys=True)


def test_nested(spark):
    schema = "b struct<z: int, a: array<struct<y: string, x: boolean>>>, a map<string, map<string, double>>, c long, s string, e array<string>"
    rows = [
        ((1, [("é\n\"\\\t", True), (None, None)]), {"zz": {"k": 1.5}, "aa": {}, "é": None}, 2**60, "\x00\x1f\x7f\b\f\r/ 😀", []),
        ((None, None), {}, None, "", [None, "", "x, y: z"]),
        (None, None, -1, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r.j for r in df.select(provenance.canonical(df, "s", "c", "b", "a", "e").alias("j")).collect()]
    assert got == [dumped(r) for r in df.collect()]
    turned = df.select("e", F.struct("b.a", "b.z").alias("b"), "s", "a", "c").where("b.z is not null")
    assert turned.select(provenance.state_fingerprint(turned, "a", "b", "c", "e", "s").alias("f")).first().f == hashlib.sha256(dumped(df.first()).encode()).hexdigest()[:16]


def test_numbers(spark):
    r = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.5, 1e7, 12345678.9, 1e15, 1e16, 123456789012345678.0, 1e-3, 1.25e-4, 1e-4, 9.99e-5, 1e-10, 1e100, 1.7976931348623157e308, 100.0, 0.1, 2**53 + 0.0]
    values += [r.uniform(-1, 1) * 10.0 ** r.randint(-20, 20) for _ in range(300)]
    values += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(300)) if math.isfinite(x)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.v, r.j) for r in df.select("v", provenance.canonical(df, "v").alias("j")).collect()]
    differ = [(v, j) for v, j in got if j != dumped({"v": v})]
    assert all(json.loads(j)["v"] == v for v, j in got) and len(got) == len(values)
    assert len(differ) < len(got) / 5 and all(sum(x.isdigit() for x in repr(v).split("e")[0].strip("-0.")) >= 16 for v, _ in differ)


def test_prompts(spark):
    df = spark.createDataFrame([("a", "é", "")], "x string, y string, z string")
    got = df.select(provenance.prompt_fingerprint("x", "y", "z").alias("f"), provenance.prompt_fingerprint("x", "z", "y").alias("g")).first()
    assert got.f == hashlib.sha256("a\0é\0".encode()).hexdigest()[:12] != got.g


def test_index_state(spark):
    want = {"collection": "c", "n_points": 10, "n_chunks": 12, "embed_model": "m", "chunk_strategy": "s", "bm25_strategy": "b"}
    df = spark.createDataFrame([(12, "m", "c", 10, "b", "s")], "n_chunks int, embed_model string, collection string, n_points long, bm25_strategy string, chunk_strategy string")
    assert df.select(provenance.index_fingerprint(df).alias("f")).first().f == hashlib.sha256(dumped({**want, "payload_schema": "2"}).encode()).hexdigest()[:16]
