"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard, results of all shards merged.

Vectors are dealt to shards by a hash of their ids; shards grow with the table up to a bound, so that a query meets as few as can be. Each shard is indexed by one task: a hierarchy of layers, each vector
in layer 0 and, ever more rarely, in higher ones, with links to near vectors in different directions. A shard's index is one row of flat
arrays (vectors, ids, and per layer the neighbours, a fixed number for each vector). Queries are dealt into blocks, and blocks into waves. A
task reads a shard's row, opens it once, and then one block of its wave after the other; so blocks travel to every shard, the far larger
shards once per wave, and a task holds one shard and one block. The best of all shards are ranked by exact cosines in double precision.
Equal vectors of a shard are one node with all their ids, so that a very common vector is neither a clique in the graph nor a tie that
hides the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.session import stage

#: Vectors of a shard, about: the first so many shards hold the smaller number; then shards grow up to the larger one.
SHARD_ROWS, FEW_SHARDS, MOST_ROWS = 4096, 16, 16384
#: Queries of a block, and blocks that one task answers.
BLOCK_ROWS, WAVE_BLOCKS = 1024, 64
#: The most partitions of a search; beyond, a task answers for several shards in turn.
MOST_TASKS = 20_000
#: Links of a vector in higher layers (twice as many in layer 0), and vectors kept while building and while searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 64
K, QUERY_EVERY = 5, 50
INDEX = "shard int, dims int, vectors binary, bounds binary, ids binary, tops binary, entry int, layers array<binary>"


class Graph:
    """Unit vectors and, per layer, a table of neighbours with -1 where there is none."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int):
        self.unit, self.layers, self.entry = unit, layers, entry

    def near(self, q: np.ndarray, layer: int, starts: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
        """The nearest nodes (distance, node) found in a layer from ``starts`` on, nearest first."""
        seen = {n for _, n in starts}
        open_, best = list(starts), [(-d, n) for d, n in starts]
        open_.sort()
        best.sort()
        table, unit = self.layers[layer], self.unit
        while open_:
            d, n = heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [x for x in table[n].tolist() if x >= 0 and x not in seen]
            if not new:
                continue
            seen.update(new)
            for x, far in zip(new, (1.0 - unit[new] @ q).tolist()):
                if len(best) < width:
                    heappush(best, (-far, x))
                    heappush(open_, (far, x))
                elif far < -best[0][0]:
                    heapreplace(best, (-far, x))
                    heappush(open_, (far, x))
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        found = [(float(1.0 - self.unit[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            found = self.near(q, layer, found[:1], 1)
        return self.near(q, 0, found, width)


def _spread(unit: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Of nodes by distance, those nearer to the new one than to any taken before; then the nearest others, up to ``most``."""
    nodes = [n for _, n in found]
    between = 1.0 - unit[nodes] @ unit[nodes].T
    taken: list[int] = []
    for i, (d, _) in enumerate(found):
        if len(taken) < most and (not taken or between[i, taken].min() > d):
            taken.append(i)
    for i in range(len(found)):
        if len(taken) >= most:
            break
        if i not in taken:
            taken.append(i)
    return [nodes[i] for i in taken]


def build(unit: np.ndarray, tops: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """A graph over unit vectors; ``tops`` is each one's highest layer."""
    n = len(unit)
    layers = [np.full((n, links * (1 if layer else 2)), -1, dtype=np.int32) for layer in range(int(tops.max()) + 1)]
    graph = Graph(unit, layers[:1], 0)
    graph.layers = layers[: int(tops[0]) + 1]
    for new in range(1, n):
        q, top = unit[new], int(tops[new])
        found = [(float(1.0 - unit[graph.entry] @ q), graph.entry)]
        for layer in range(len(graph.layers) - 1, -1, -1):
            if layer > top:
                found = graph.near(q, layer, found[:1], 1)
                continue
            found = graph.near(q, layer, found, width)
            table = layers[layer]
            chosen = _spread(unit, found, links)
            table[new, : len(chosen)] = chosen
            for other in chosen:
                row = table[other]
                free = int((row >= 0).sum())
                if free < len(row):
                    row[free] = new
                else:
                    near = [*row.tolist(), new]
                    far = (1.0 - unit[near] @ unit[other]).tolist()
                    row[:] = _spread(unit, sorted(zip(far, near)), len(row))
        if top >= len(graph.layers):
            graph.entry, graph.layers = new, layers[: top + 1]
    return graph


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that have a direction: not null or empty, all components finite, not all zero; with an id."""
    v = F.col(vector_col).cast("array<double>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id IS NOT NULL AND size(v) > 0")
        .where(F.forall("v", good) & F.exists("v", lambda x: x != 0))
    )


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return np.ascontiguousarray(scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)))


def shard_count(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards for ``n`` vectors; which shard holds a vector never depends on the cluster."""
    return max(1, min(-(-n // shard_rows), FEW_SHARDS), -(-n // max(shard_rows, MOST_ROWS)))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """One row per shard and number of dimensions from (vec_id, v)."""
    shards = shard_count(rows.count(), shard_rows)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dims", F.size("v"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        vectors, ids = _matrix(frame["v"]), frame["vec_id"].to_numpy()
        keys: dict[bytes, int] = {}
        node = np.array([keys.setdefault(v.tobytes(), len(keys)) for v in vectors + 0.0])  # + 0.0: a negative zero is a zero
        first = np.unique(node, return_index=True)[1]
        held = np.unique(np.stack([node, ids], axis=1), axis=0)  # by node, then by id
        bounds = np.searchsorted(held[:, 0], np.arange(len(first) + 1))
        generator = np.random.default_rng(int(key[0]) * 1_000_003 + len(first))
        tops = np.minimum(-np.log(1 - generator.random(len(first))) / np.log(links), 8).astype(np.int32)
        graph = build(_unit(vectors[first]).astype(np.float32), tops, links, width)
        return pd.DataFrame([{
            "shard": key[0], "dims": key[1], "vectors": vectors[first].astype("<f8").tobytes(), "bounds": bounds.astype("<i8").tobytes(), "ids": held[:, 1].astype("<i8").tobytes(),
            "tops": tops.astype("<i4").tobytes(), "entry": graph.entry, "layers": [x.astype("<i4").tobytes() for x in graph.layers],
        }])

    return dealt.groupBy("shard", "dims").applyInPandas(run, INDEX)


def _open(r: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(r["vectors"], dtype="<f8").reshape(-1, r["dims"])
    layers = [np.frombuffer(x, dtype="<i4").reshape(len(vectors), -1) for x in r["layers"]]
    return Graph(_unit(vectors).astype(np.float32), layers, r["entry"]), vectors, np.frombuffer(r["bounds"], dtype="<i8"), np.frombuffer(r["ids"], dtype="<i8")


def search(indexed: DataFrame, queries: DataFrame, k: int = K, width: int = SEARCH_WIDTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each of (vec_id, v), ties to the smaller id, its own id left out."""
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dims", F.size("v"))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame([{"block": key[0], "dims": key[1], "query_ids": frame["vec_id"].to_numpy().astype("<i8").tobytes(), "queries": _matrix(frame["v"]).astype("<f8").tobytes()}])

    grouped = stage(asked.groupBy("block", "dims").applyInPandas(gather, "block int, dims int, query_ids binary, queries binary"))
    waves = -(-blocks // WAVE_BLOCKS)
    shards = (indexed.agg(F.max("shard")).first()[0] or 0) + 1
    # A stated query set against all rows, in blocks. Within (shard, wave, dims) the shard's row, of block -1, comes first.
    each_wave, each_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (waves, shards))
    shelves = indexed.withColumn("wave", each_wave).withColumn("block", F.lit(-1))
    asking = grouped.withColumn("shard", each_shard).withColumn("wave", F.floor(F.col("block") / WAVE_BLOCKS).cast("int"))
    spread = max(min(shards * waves, MOST_TASKS), indexed.sparkSession.sparkContext.defaultParallelism * 4)
    tasks = shelves.unionByName(asking, allowMissingColumns=True).repartition(spread, "shard", "wave").sortWithinPartitions("shard", "wave", "dims", "block")

    def answers(r: dict, held: tuple) -> pa.RecordBatch:
        graph, vectors, bounds, ids = held
        out = {"query_id": [], "vec_id": [], "score": []}
        q_ids, q = np.frombuffer(r["query_ids"], dtype="<i8"), np.frombuffer(r["queries"], dtype="<f8").reshape(-1, r["dims"])
        for q_id, own, unit in zip(q_ids.tolist(), q, _unit(q).astype(np.float32)):
            nodes = [n for _, n in graph.search(unit, max(width, k + 1))]
            found = []
            for n, s in zip(nodes, cosines(own, vectors[nodes]).tolist()):
                found += [(-s, v) for v in ids[bounds[n] : min(bounds[n + 1], bounds[n] + k + 1)].tolist() if v != q_id]
            for s, v in sorted(found)[:k]:
                out["query_id"].append(q_id)
                out["vec_id"].append(v)
                out["score"].append(-s)
        return pa.RecordBatch.from_pydict(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, held = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["block"] < 0:
                    shelf, held = (r["shard"], r["wave"], r["dims"]), _open(r)
                elif shelf == (r["shard"], r["wave"], r["dims"]):  # else the shard holds no vectors of so many dimensions
                    yield answers(r, held)

    each = tasks.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; the same for the same two vectors, wherever they stand."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all vectors for those that ``is_query`` (a condition on vec_id) picks.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors only meet those of as many
    dimensions. Rows that repeat an id and a vector count once.
    """
    rows = stage(usable(vectors, id_col, vector_col))
    return search(stage(index(rows)), rows.where(is_query).distinct(), k)
