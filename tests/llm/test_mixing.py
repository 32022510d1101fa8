"""Mixes against their contract and against serving one document after the other."""

import hashlib
import re

import pytest

from shelfscope.llm import mixing as M


def plain_targets(sizes, budget):
    """Shares by weight, the excess of full sources shared again."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted((x for x in sizes if x is not None)) + [None] * (None in sizes))}
    full = set()
    while True:
        left, over = budget - sum(3 * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        share = {s: 3 * sizes[s] if s in full else left * weight[s] / over for s in sizes}
        above = {s for s in sizes if s not in full and share[s] > 3 * sizes[s]}
        if not above:
            return share
        full |= above


def plain(rows):
    """(doc_id, size, source_size, target, taken) by serving all copies in order of their finish."""
    held = [(i, s, len([w for w in re.split("[ \t-\r]+", t or "") if w])) for i, t, s in rows]
    sizes = {}
    for _, s, n in held:
        sizes[s] = sizes.get(s, 0) + n
    budget = sum(sizes.values())
    target = plain_targets(sizes, budget)
    place = {s: i for i, s in enumerate(sorted(x for x in sizes if x is not None) + [None])}
    served, given = [], {}
    key = lambda k: (place[held[k][1]], hashlib.md5((" " if held[k][0] is None else str(held[k][0])).encode()).hexdigest(), held[k][2])
    for k in sorted(range(len(held)), key=key):
        _, s, n = held[k]
        given[s] = given.get(s, 0) + n
        for again in range(3):
            if n and target[s] and again * sizes[s] + given[s] - n <= target[s]:
                served.append(((again * sizes[s] + given[s]) / target[s], place[s], given[s], again, k))
    taken, spent = [0] * len(held), 0
    for *_, k in sorted(served):
        spent += held[k][2]
        if spent > budget:
            break
        taken[k] += held[k][2]
    return sorted([(i, n, sizes[s], round(target[s], 6), taken[k]) for k, (i, s, n) in enumerate(held)], key=str)


def mixed(docs, **more):
    return sorted([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix(docs, **more).collect()], key=str)


@pytest.mark.parametrize("hot", [0, 400])
def test_against_serving_one_by_one(spark, documents, hot):
    rows = [(i, "w " * (i * 7919 % 90), f"src{i % 7}" if i % 7 else None) for i in range(300)] + [(1000 + i, "w " * 30, "src3") for i in range(hot)]
    rows += [(5000, "w " * 5, "small"), (5001, "w " * 2, "~"), (5002, "w " * 3, "")]
    docs = documents(*rows)
    got = mixed(docs.repartition(5))
    assert got == plain(rows) == mixed(docs)
    assert any(r[4] > r[1] for r in got) and all(r[4] in (0, r[1], 2 * r[1], 3 * r[1]) for r in got)
    total, largest = sum(r[1] for r in got), max(r[1] for r in got)
    assert total - largest <= sum(r[4] for r in got) <= total
    given = {}
    for r in got:
        given[r[2:4]] = given.get(r[2:4], 0) + r[4]
    assert all(abs(n - target) <= largest for (_, target), n in given.items())


def test_odd_rows(odd, nothing, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert mixed(odd) == plain(rows)
    assert mixed(nothing) == []
    assert mixed(documents((1, None), (2, " "))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_repeated_rows_are_taken_alike(documents):
    rows = [(1, "a b c", "x")] * 200 + [(None, "a b", "x")] * 100 + [(2, "a", "y")]
    assert mixed(documents(*rows).repartition(3)) == plain(rows)
