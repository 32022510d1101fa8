"""Neighbours against all vectors."""

import numpy as np
from pyspark.sql import functions as F

from shelfscope.llm import ann

KIND = "vec_id long, embedding array<float>, shard string, v int"


def nearest(ids, vectors, q, k):
    scores = ann.cosines(vectors[q], vectors)
    return sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != ids[q])[:k]


def recall(spark, ids, vectors, monkeypatch=None):
    rows = spark.createDataFrame([(i, v.tolist(), "s", 1) for i, v in zip(ids, vectors)], KIND)
    found = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    wide = vectors.astype(np.float64)
    for q, i in enumerate(ids):
        if i % 50 == 0:
            best = nearest(ids, wide, q, 5)
            got = sorted(found[i])
            assert [g[0] for g in got] == list(range(1, len(best) + 1))
            assert all(abs(s - float(ann.cosines(wide[q], wide[[ids.index(v)]])[0])) < 1e-12 for _, v, s in got)
            hits += len({v for _, v, _ in got} & {v for _, v in best})
            total += len(best)
    return hits / total


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann.index, "__defaults__", (700, *ann.index.__defaults__[1:]))
    monkeypatch.setattr(ann.search, "__defaults__", (*ann.search.__defaults__[:2], 16))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    vectors = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    assert recall(spark, list(range(3000)), vectors) >= 0.95


def test_recall_on_the_table_over_many_shards_and_waves(spark, monkeypatch):
    """2,000 vectors in five shards, 40 queries in several blocks and waves."""
    monkeypatch.setattr(ann.index, "__defaults__", (400, *ann.index.__defaults__[1:]))
    monkeypatch.setattr(ann.search, "__defaults__", (*ann.search.__defaults__[:2], 4))
    monkeypatch.setattr(ann, "WAVE_BLOCKS", 3)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").dropDuplicates(["vec_id"]).orderBy("vec_id").collect()
    assert recall(spark, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float32)) >= 0.95


def test_shards_grow_with_the_table():
    assert [ann.shard_count(n) for n in (0, 1, 4096, 4097, 51_282, 65_536, 262_144, 262_145, 10**9)] == [1, 1, 1, 2, 13, 16, 16, 17, 61_036]


def test_a_very_common_vector(spark):
    """Ties go to the smaller id, copies on all sides."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[::2] = vectors[0]
    rows = spark.createDataFrame([(i, v.tolist(), "s", 1) for i, v in enumerate(vectors)], KIND)
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(rows, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 2), (3, 4), (4, 6), (5, 8)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], KIND)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 0.707107), (0, 2, 50, 0.0), (50, 1, 1, 0.707107), (50, 2, 0, 0.0)]
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
