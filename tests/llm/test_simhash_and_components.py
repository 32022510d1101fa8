"""Fingerprints, links and components against all pairs on small tables."""

import random

import xxhash

from shelfscope.llm import simhash_dedup as S
from shelfscope.llm.components import components


def plain_print(text):
    words = [w for w in bytes((text or "").encode()).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(grams))


def groups(nodes, linked):
    """Smallest reachable node of each, by plain search."""
    least = {}
    for n in sorted(nodes):
        if n in least:
            continue
        reached, open_ = {n}, [n]
        while open_:
            x = open_.pop()
            for y in linked(x):
                if y not in reached:
                    reached.add(y)
                    open_.append(y)
        least |= dict.fromkeys(reached, n)
    return least


def texts(rng, n):
    bases = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=rng.randint(1, 120))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(200)}"
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


def test_components_equal_all_pairs_of_fingerprints(documents):
    own = dict(enumerate([*texts(random.Random(11), 160), None, "", "  \n"]))
    prints = {i: plain_print(t) for i, t in own.items()}
    expected = groups(own, lambda i: [j for j in own if bin(prints[i] ^ prints[j]).count("1") <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(documents(*own.items())).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in own}


def test_variants_meet_whatever_two_bits_differ(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [base] + [base ^ (1 << a) ^ (1 << b if b != a else 0) for a in range(0, 64, 7) for b in range(0, 64, 9)]
    rows = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(near)], "doc_id long, print long")
    assert {r["component_id"] for r in S.classes(rows).collect()} == {0}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 400)] + [(500, 501), (501, 502), (502, 500), (503, 503), (500, 501)]
    nodes = {x for e in edges for x in e}
    around = {n: set() for n in nodes}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    expected = {n: m for n, m in groups(nodes, around.__getitem__).items() if n != m}
    got = {r["node"]: r["least"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shares(a, b):
    a, b = (set(S.shingles(S.words(t), 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_near_and_found(documents):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    bases = [" ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(300)) for _ in range(60)]
    rows, copies = list(enumerate(bases)), {}
    for i, b in enumerate(bases):
        w = b.split()
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(w)))
        copies[100 + i] = i
    rows.append((900, " ".join(vocabulary[:300])))
    own = dict(rows)
    found = {r["doc_id"]: r["copy_of"] for r in S.near_copies(documents(*rows)).collect()}
    assert all(shares(own[d], own[c]) >= 0.8 for d, c in found.items()) and 900 not in found
    near = [d for d, c in copies.items() if shares(own[d], own[c]) >= 0.8]
    assert len(near) > 50 and sum(d in found for d in near) >= 0.9 * len(near)
    kept = S.without_copies(documents(*rows))
    assert {r["doc_id"] for r in kept.collect()} == set(own) - set(found) and "_listed" in kept.columns


def near_groups(own):
    """Smallest id of each text's group, by comparing all pairs."""
    sets = {i: set(S.shingles(S.words(t), 5)) for i, t in own.items()}
    return groups(own, lambda i: [j for j in own if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])


def test_all_pairs_of_near_copies_are_found(documents):
    """Copies with a passage appended, whose word fingerprints are far apart, and short texts with one edit near an end."""
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(5000)]
    own = {}
    for i in range(60):
        n = rng.randint(60, 250)
        own[i] = rng.choices(vocabulary, k=n)
        own[1000 - i] = own[i] + rng.choices(vocabulary, k=int(n * rng.uniform(0.05, 0.3)))
        own[2000 + i] = ["other", *own[i][1:]]
    own = {i: " ".join(w) for i, w in own.items()}
    expected = {i: m for i, m in near_groups(own).items() if i != m}
    assert len(expected) > 100
    assert {r["doc_id"]: r["copy_of"] for r in S.near_copies(documents(*own.items())).collect()} == expected


def test_copies_with_other_texts_of_the_same_words_between_them(documents):
    """All texts have the same words in another order, so one word fingerprint; a copy's neighbours by id are no copies."""
    rng = random.Random(7)
    base = [f"word{i}" for i in range(120)]
    own = {}
    for i in range(50):
        text = rng.sample(base, 120)
        own[i] = " ".join(text)
        own[100 + i] = " ".join([*text[:-2], text[-1], text[-2]])
    found = {r["doc_id"]: r["copy_of"] for r in S.near_copies(documents(*own.items())).collect()}
    assert found == {100 + i: i for i in range(50)} == {i: m for i, m in near_groups(own).items() if i != m}


def test_texts_of_a_group_that_are_not_near_leave_no_pairs(documents, monkeypatch):
    """Drafts of one text with so many edits that few are near each other; all have its shingles in common."""
    rng = random.Random(9)
    base = [f"word{i}" for i in range(200)]
    own = {i: [f"new{i}x{j}" if j in edits else w for j, w in enumerate(base)] for i in range(150) for edits in [set(rng.sample(range(200), rng.randint(2, 7)))]}
    own = {i: " ".join(w) for i, w in own.items()}
    sets = {i: set(S.shingles(S.words(t), 5)) for i, t in own.items()}
    near = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for i in own for j in own if i < j)
    proposed, between = [], S._between

    def counted(*given):
        proposed.append((out := between(*given)).count())
        return out

    monkeypatch.setattr(S, "_between", counted)
    found = {r["doc_id"]: r["copy_of"] for r in S.near_copies(documents(*own.items())).collect()}
    assert found == {i: m for i, m in near_groups(own).items() if i != m}
    assert found and len(proposed) == 1 and proposed[0] <= 2 * near


def test_odd_rows(odd, nothing):
    got = S.near_duplicates(odd).collect()
    assert len(got) == 11 and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in got if r["doc_id"] in (8, 9)} == {8}
    assert S.near_duplicates(nothing).count() == 0
    kept = [r["doc_id"] for r in S.without_copies(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 5, 6, 7, None, 8], key=str)
    assert S.without_copies(nothing).count() == 0
