"""Packing and placement against plain versions."""

import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from shelfscope.llm import packing, sharding, simhash_dedup


def plain_pack(rows, capacity, limit):
    """Each bin looked at for each piece."""
    bins, got = [], []
    for size, source, cluster in rows:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"] and (source is None or b["sources"].count(source) < limit)]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "clusters": [], "sources": []})
            i = len(bins) - 1
        bins[i]["room"] -= size
        bins[i]["clusters"].append(cluster)
        bins[i]["sources"].append(source)
        got.append(i)
    return got


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_looking_at_every_bin(seed):
    rng = random.Random(seed)
    n, limit = 400, rng.choice([1, 2, 4])
    frame = pd.DataFrame({
        "doc_id": range(n), "piece": 0, "size": [rng.choice([100, rng.randint(1, 100), 33]) for _ in range(n)],
        "source": [rng.choice([None, "hot", "hot", "a", "b", "c"]) for _ in range(n)], "cluster": [rng.choice([0, rng.randint(1, 10_000)]) for _ in range(n)],
    })
    got = packing.pack_group(frame, 100, limit)
    assert got["bin"].tolist() == plain_pack([(s, None if pd.isna(o) else o, c) for s, o, c in zip(got["size"], got["source"], got["cluster"])], 100, limit)


def test_no_piece_is_lost_and_no_conflict_made(documents):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 150))) for _ in range(300)] + ["same words"] * 100
    docs = documents(*((i, t, f"src{i % 3 if i % 2 else 0}") for i, t in enumerate(texts)))
    out = packing.pack(docs, capacity=64, source_limit=2, group_pieces=150).toPandas()
    need = {i: len(t.split()) + 1 for i, t in enumerate(texts)}
    assert out.groupby("doc_id")["size"].sum().to_dict() == need
    assert (out.groupby(["bin_group", "bin"])["size"].sum() <= 64).all() and out["bin_group"].nunique() > 1
    out["source"] = out["doc_id"].map(lambda i: f"src{i % 3 if i % 2 else 0}")
    out["text"] = out["doc_id"].map(lambda i: texts[i])
    for _, b in out.groupby(["bin_group", "bin"]):
        assert b["source"].value_counts().max() <= 2 and b["text"].is_unique


def test_odd_rows_are_packed(odd, nothing):
    out = packing.pack(odd, capacity=1000).toPandas()
    assert len(out) == 10 + 121 and packing.pack(nothing).count() == 0


def test_lookup_table_equals_taking_turns_over_whole_orders():
    shards, slots = ["a", "b", "c", "d"], 101
    orders = []
    for s in shards:
        first, step = sharding.preference(s, slots)
        orders.append([(first + i * step) % slots for i in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(x for x in orders[turn % 4] if x not in owner)] = turn % 4
        turn += 1
    table = sharding.lookup_table(shards, slots)
    assert table == [owner[i] for i in range(slots)] and max(map(table.count, range(4))) - min(map(table.count, range(4))) <= 1


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i}" for i in range(10)]
    before, after = sharding.lookup_table(shards), sharding.lookup_table(shards[:-1])
    stayed = [a == b for a, b in zip(before, after) if b is not None and a != 9]
    assert sum(stayed) > 0.9 * len(stayed)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_rows_are_placed_by_the_table(spark, odd, nothing, folder):
    import hashlib

    shards = ["a", "b", "c"]
    table = sharding.lookup_table(shards, 1009)
    for r in sharding.place(odd, "doc_id", shards, 1009).collect():
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % 1009
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    assert sharding.place(nothing, "doc_id", shards).count() == 0 and sharding.place(odd, "doc_id", shards).count() == 11
    sharding.write_shards(odd, "doc_id", shards, folder)
    assert spark.read.parquet(folder).count() == 11


def test_equal_rows_are_dealt_out_like_others(documents):
    """Two thirds of the rows are one row without an id; no group gets much more than its size."""
    rows = [(None, "same words again", "s")] * 4_000 + [(i, f"text {i}", "s") for i in range(2_000)]
    got = packing.pack(documents(*rows), group_pieces=500).groupBy("bin_group").count().collect()
    assert sum(r["count"] for r in got) == 6_000 and max(r["count"] for r in got) <= 1_000


def test_near_copies_share_no_bin(spark, documents):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(600)) for _ in range(20)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in texts]
    docs = documents(*enumerate(texts + near + texts), (None, None), (None, ""), (7, None, None))
    rows = packing.clustered(docs)
    of = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs).where("doc_id < 60 AND component_id <> -1").collect() if r["doc_id"] != 7}
    assert len(set(of.values())) < 30 and rows.count() == 63
    bins = {}
    for r in packing.pack(rows, capacity=2048, length=F.col("n"), cluster=F.col("cluster")).where("doc_id < 60 AND doc_id <> 7").collect():
        bins.setdefault((r["bin_group"], r["bin"]), []).append(of[r["doc_id"]])
    assert all(len(set(b)) == len(b) for b in bins.values()) and any(len(b) > 1 for b in bins.values())
