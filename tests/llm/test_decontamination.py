"""Benchmark passages in documents, against plain comparisons."""

import random
from collections import Counter

from shelfscope.llm import decontaminate as D

ITEMS = "item_id int, text string, size long, place string"


def grams(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] if words else []


def similarity(a, b):
    a, b = Counter(grams(a)), Counter(grams(b))
    return sum((a & b).values()) / sum((a | b).values())


def test_planted_passages_are_found_wherever_they_stand(spark, documents):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = {i: rng.choices(words, k=rng.randint(15, 60)) for i in range(40)}
    docs, planted = {}, set()
    for d in range(120):
        w = rng.choices(words, k=rng.randint(0, 300))
        if d % 3 == 0:
            item, at, copy = rng.randrange(40), rng.randint(0, len(w)), None
            copy = list(items[item])
            if d % 2 and len(copy) > 50:
                copy[-1] = "other"
            w[at:at] = copy
            planted.add((d, item))
        docs[d] = w
    bench = spark.createDataFrame([(i, " ".join(w).capitalize() + ".", 1, "p") for i, w in items.items()], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r for r in D.find(documents(*((d, ", ".join(w)) for d, w in docs.items())), bench).collect()}
    expected = set()
    for d, w in docs.items():
        for i, item in items.items():
            if not set(grams(w)) & set(grams(item)):
                continue
            best = max((similarity(w[s : s + len(item)], item) for s in range(max(1, len(w)))), default=0)
            if best >= 0.8:
                expected.add((d, i))
                assert abs(got[d, i]["similarity"] - best) < 1e-9
    assert set(got) == expected and planted <= expected


def test_edited_passages_are_found_whatever_their_fingerprints(spark, documents):
    """One edit in items of 50 words, two or three in longer ones: 0.8 is reached, by many not within any small radius."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(20_000)]
    items = {i: rng.choices(words, k=rng.choice([50, 60, 97, 140])) for i in range(60)}
    docs, expected = {}, set()
    for i, item in items.items():
        for n in range(10):
            copy = list(item)
            for at in rng.sample(range(4, len(copy) - 4), {50: 1, 60: 1, 97: 2, 140: 3}[len(copy)]):
                copy[at] = "edited"
            docs[10 * i + n] = rng.choices(words, k=20) + copy + rng.choices(words, k=20)
            if similarity(copy, item) >= 0.8:
                expected.add((10 * i + n, i))
    bench = spark.createDataFrame([(i, " ".join(w), 1, "p") for i, w in items.items()], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in D.find(documents(*((d, " ".join(w)) for d, w in docs.items())), bench).collect()}
    assert len(expected) > 500 and got == expected


def test_repeats_short_items_and_odd_rows(spark, documents, odd, nothing):
    bench = spark.createDataFrame([(1, "la la la la la la la la", 1, "p"), (2, "tiny item", 1, "p"), (3, None, 1, "p"), (4, "", 1, "p"), (5, "one two three four five six " * 3, 1, "p"), (5, "one two three four five six " * 3, 1, "p")], ITEMS)
    docs = documents((1, "la la la la la la la la"), (2, "Tiny item!"), (3, "a tiny item in more words"), (4, None), (4, ""))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.find(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0}
    assert {(r["doc_id"], r["item_id"]) for r in D.find(odd, bench).collect()} == {(7, 5)}
    assert D.find(nothing, bench).count() == 0 and D.find(docs, bench.limit(0)).count() == 0


def test_every_pair_within_the_radius_meets(spark):
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, 30, rng.getrandbits(64)) for i in range(30)]
    windows = []
    for i, _, p in items:
        for n in range(0, 20):
            flips = 0
            for b in rng.sample(range(64), n):
                flips |= 1 << b
            windows.append((100 * i + n, 0, 30, p ^ flips))
    a = spark.createDataFrame([(d, s, z, signed(p)) for d, s, z, p in windows], "doc_id long, start int, size int, print long")
    b = spark.createDataFrame([(i, z, signed(p)) for i, z, p in items], "item_id int, size int, item_print long")
    got = {(r["doc_id"], r["item_id"]) for r in D.within_radius(a, b).collect()}
    assert got == {(d, i) for d, _, _, p in windows for i, _, q in items if bin(p ^ q).count("1") <= D.RADIUS}
