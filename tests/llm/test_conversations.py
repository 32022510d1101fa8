"""Cheapest repairs against all repairs, and conversations cut into pieces against whole ones."""

import hashlib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, piece long, audit string, who string"


def table(spark, rows):
    return spark.createDataFrame([(*r, False, 7, "x", "y") for r in rows], SCHEMA)


def every_repair(rows, found, most):
    """(cost, audit, repaired) of all edits that lead to a conversation of at most ``most`` roles."""
    targets = [lead + "ua" * n for n in range(1, most // 2 + 1) for lead in ("", "s")] + [""]
    out = []

    def go(target, i, j, cost, audit, said):
        if i == len(rows) and j == len(target):
            out.append((cost, audit, "\n".join(said)))
        if j < len(target) and target[j] in C.ROLES:
            go(target, i, j + 1, cost + 3, audit + "I", [*said, f"{C.ROLES[target[j]]}:"])
        if i < len(rows):
            role, text = rows[i]
            go(target, i + 1, j, cost + 4, audit + "D", said)
            if found[i] not in ("blank", "duplicate") and j < len(target):
                extra = 3 if found[i] == "truncated" else 0
                if role[:1] == target[j]:
                    go(target, i + 1, j + 1, cost + extra, audit + "K", [*said, f"{role}:{text}"])
                elif target[j] in C.ROLES:
                    go(target, i + 1, j + 1, cost + extra + 3, audit + "R", [*said, f"{C.ROLES[target[j]]}:{text}"])

    for target in targets:
        go(target, 0, 0, 0, "", [])
    return out


def plain(rows):
    """A conversation's row of the result by trying everything; ``rows`` are (turn, role, text) in order."""
    seen, found = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, said = min(every_repair([(r, t) for _, r, t in rows], found, len(rows) + 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def test_cheapest_repair_of_short_conversations():
    texts = ["Yes.", "No", "", " \n", "Why?", "ünï!"]
    rng = random.Random(3)
    cases = [[(i, r, rng.choice(texts)) for i, r in enumerate(roles)] for n in range(4) for roles in product(("system", "user", "assistant", "tool"), repeat=n)]
    for rows in cases:
        marked = [(t, r, x, x) for t, r, x in rows]
        assert tuple(C.repair_whole(marked).values()) == plain(rows), rows


def random_rows(rng, conv, n):
    roles, texts = ["system", "user", "assistant", "", "sue", "User"], ["One.", "Two", "", "Three!", "\t", "Four, and five"]
    return [(conv, rng.choice([None, i, i, i + rng.randint(0, 3)]), rng.choice(roles[: rng.randint(1, 6)]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


@pytest.mark.parametrize("piece_rows", [1, 3, 2_000])
def test_pieces_give_what_whole_conversations_give(spark, monkeypatch, piece_rows):
    """Partitions cut conversations anywhere, pieces of a few rows many times more."""
    rng = random.Random(piece_rows)
    rows = [r for conv in [None, *range(12)] for r in random_rows(rng, conv, rng.randint(1, 60))]
    rng.shuffle(rows)
    monkeypatch.setattr(C, "PIECE_ROWS", piece_rows)
    got = {r[0]: tuple(r)[1:] for r in C.repair(table(spark, rows).repartition(4)).collect()}
    for conv in [None, *range(12)]:
        own = in_order([r for r in rows if r[0] == conv])
        marked = [(t, r, x, hashlib.md5(x.encode()).hexdigest()) for _, t, r, x in own]
        assert got[conv] == tuple(C.repair_whole(marked).values()), conv


def test_one_conversation_with_nearly_all_rows(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Row {i}." if i % 50 else "") for i in range(9_000)] + [(2, 0, "user", "Hm.")]
    got = {r["conv_id"]: r for r in C.repair(table(spark, rows)).collect()}
    whole = C.repair_whole([(t, r, x, x) for _, t, r, x in in_order([r for r in rows if r[0] == 1])])
    assert got[1]["audit"] == whole["audit"] and got[1]["repaired_sha256"] == whole["repaired_sha256"] and len(got[1]["audit"]) >= 9_000
    assert (got[2]["cost"], got[2]["audit"]) == (3, "KI")


def test_nulls_dropped_rows_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 4, "user", "x" * 300_000 + "."), (1, 4, "user", "x" * 300_000 + "."), (1, 7, "assistant", "Yes."), (None, 1, "user", "Hm")]
    got = {r["conv_id"]: r for r in C.repair(table(spark, rows)).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["illegal"], got[1]["cost"], got[1]["audit"]) == (2, 1, 1, 2, 8, "DKDK")
    assert (got[None]["truncated"], got[None]["cost"], got[None]["audit"]) == (1, 4, "D")
    gone = C.repair(table(spark, rows), F.col("conv_id") == 1).where("conv_id = 1").collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(table(spark, rows).limit(0)).count() == 0


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "What. a! b? c") for c in (None, 1, 2) for t in (None, *range(40))]
    damaged, dropped = C.damage(table(spark, rows))
    got = sorted(damaged.where(~dropped).select("conv_id", "turn", "role", "text").collect(), key=str)
    wanted = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "What a b c"}.get(code, text)
        wanted += [(c, t, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((spark.createDataFrame(wanted, "conv_id long, turn long, role string, text string")).collect(), key=str)]
