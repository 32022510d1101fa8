"""Segments against all segments, and accuracy on held-out rows."""

import random

from pyspark.sql import functions as F

from shelfscope.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def plain_segments(scores):
    """Maximal scoring segments by their definition: take the best (first, then shortest) segment, then go on left and right of it."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (top is None or total > top[2] or total == top[2] and (i, j + 1) < top[:2]):
                    top = (i, j + 1, total)
        return [] if top is None else best(lo, top[0]) + [top] + best(top[1], hi)

    return best(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice([-1, 1]) * rng.randint(1, 10**6) for _ in range(rng.randint(0, 25))]
        assert T.segments(scores) == plain_segments(scores)


def test_scores_equal_a_plain_recomputation(spark):
    """Word scores, best segment, surplus over chance, further passages and the curve, worked out by their definitions."""
    import math

    known = {"awful": 6.0137, "vile": 1.4931, "calm": -0.4719, "vilen*": 5.0273}  # no words sum up to nothing: on such ties the shorter segment counts
    model = T.Model(known, rate=1.3, size=0.2, slope=0.8, shift=-1.0)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["awful", "Vile", "calm", "vileness", "vilen", "word", "é"], [1, 1, 4, 1, 1, 9, 2], k=rng.randint(0, 30))) for _ in range(50)] + ["", None, "1 2 3"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["j"] for r in frame.select("i", T.judge_column(spark, model, F.col("t")).alias("j")).collect()}
    for i, text in enumerate(texts):
        words = [w for w in (text or "").lower().split() if w.isalpha()]
        scores = [(known["vilen*"] if w.startswith("vilen") else known.get(w, 0.0)) - 0.25 for w in words]
        surplus = sorted((1.3 * s - math.log(0.2 * max(1, len(words))) for _, _, s in plain_segments(scores)), reverse=True) or [-math.log(0.2 * max(1, len(words)))]
        large = [s for s in surplus if math.exp(-s) <= 0.05]
        evidence = surplus[0] + sum(large[1:])
        assert got[i]["passages"] == len(large) and abs(got[i]["evidence"] - evidence) < 1e-9
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-max(-30, min(30, 0.8 * evidence - 1))))) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = T.predictions(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", F.col("toxic").alias("y"), "score").toPandas()
    # About a tenth of the rows labelled toxic hold no word that tells them from others.
    assert ((got["predicted"] == 1) & (got["y"] == 1)).sum() >= 0.85 * (got["y"] == 1).sum()
    assert ((got["predicted"] == 1) & (got["y"] == 0)).sum() <= 0.01 * (got["y"] == 0).sum()
    assert got["score"].between(0, 1).all()


def test_passages_lie_where_the_words_are(spark, documents):
    model = T.Model({"awful": 6.0, "vilen*": 5.0}, rate=1.0, size=0.1, slope=1.0, shift=0.0)
    docs = documents((1, "calm " * 50 + "awful awful vileness " + "calm " * 100 + "awful awful"), (2, "calm words"), (3, None))
    got = sorted((r["doc_id"], r["first_word"], r["last_word"]) for r in T.passages(docs, model).collect())
    assert got == [(1, 50, 53), (1, 153, 155)]


def test_few_or_no_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "x"), (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    for known in (labels, labels.limit(0)):
        got = T.predictions(odd, known).collect()
        assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert T.predictions(nothing, known).count() == 0


def test_fold(spark):
    import zlib

    ids = [1, 2, 3, 50, 12345, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", T.fold(F.col("i")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str("" if r["i"] is None else r["i"]).encode()) % 5 for r in rows)
