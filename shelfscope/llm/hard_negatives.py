"""Hard negatives by exact integer scores: matrix products in a residue number system.

Components are whole numbers. Their residues modulo a few small primes are multiplied as float32 matrices: residues are balanced around zero and
the primes so small that no sum leaves the whole numbers float32 holds, so each product is exact. Chinese remaindering in balanced mixed
radix gives the signed score. The primes multiply to more than twice the largest square of a vector's length, the most a score can be.

Anchors are a stated set against all rows, in blocks: each block of rows meets each block of anchors once per pass and leaves a few rows for each anchor.
The first pass finds the positives; the second takes, for each positive, the best scores within its window. Memory is that of one block and a
strip of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.session import stage

#: Positives of an anchor, negatives of a positive, and the window of negative scores in hundredths of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Rows and anchors that meet at once, and the anchors whose scores are held at once.
BLOCK_ROWS, BLOCK_ANCHORS, STRIP = 8_192, 1_024, 64
#: Blocks of anchors that a task holds beside a block of rows, some 400 KB each.
WAVE = 64
#: Size of sums that leaves room below the 2^24 whole numbers float32 holds, terms of a product summed at once, and the largest square of a vector's length.
EXACT, TERMS, LONGEST = 1 << 23, 1_024, float(1 << 62)
SCALE, ANCHOR_EVERY = 256, 100
_NONE = np.iinfo(np.int64).max


def primes_for(bound: int, dims: int) -> list[int]:
    """Odd primes, largest first, whose residues can be multiplied exactly and that multiply to more than twice ``bound``."""
    half = isqrt(EXACT // max(1, min(dims, TERMS)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound or not found:
        if p < 3:
            raise ValueError("no primes left for scores this large")
        if all(p % d for d in range(3, isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers modulo an odd p, from -(p-1)/2 to (p-1)/2."""
    return (x + p // 2) % p - p // 2


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of a @ b.T for balanced float32 matrices."""
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, a.shape[1], TERMS):
        total += balanced(a[:, at : at + TERMS] @ b[:, at : at + TERMS].T, p)
        total = balanced(total, p)
    return total


def reconstruct(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers with these residues that are nearest to zero, by mixed-radix digits that are balanced like the residues."""
    number, radix = residues[0].astype(np.int64), primes[0]
    for r, p in zip(residues[1:], primes[1:]):
        digit = balanced((r.astype(np.int64) - number % p) * pow(radix, -1, p), p)
        with np.errstate(over="ignore"):  # what is left out of 64 bits cancels out: the number itself fits
            number = number + digit * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= p
    return number


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two residue matrices (prime, row, component)."""
    return reconstruct([product(a[i], b[i], p) for i, p in enumerate(primes)], primes)


def first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, highest first, ties by place."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        places = np.flatnonzero(score >= least)
        return places[np.argsort(-score[places], kind="stable")][:k]
    return np.argsort(-score, kind="stable")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): rows with a label whose components are all finite, each ``floor(scale * x)``.

    ``row`` tells rows apart that repeat an id. Vectors with whole components longer than the root of 2^62 are left out, as their
    scores may not fit a long.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label = F.col("label") if label is None else label
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
        .where(F.col("label").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", finite))
        .where(squares < LONGEST)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))
    )


def _blocks(rows: DataFrame, size: int, primes: dict[int, list[int]]) -> DataFrame:
    """One row per block: ids, labels, residues, and the lists of positives where there are some; rows in order of ids, nulls last."""
    count = max(1, -(-rows.count() // size))
    # A block beyond the number wanted, where numbers of dimensions differ, is only a smaller block.
    dealt = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(_NONE))).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")).withColumn("dims", F.size("v"))
    with_positives = "positives" in rows.columns

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["vec_id"].to_numpy(dtype=np.int64)
        order = np.lexsort((frame["row"].to_numpy(), ids))
        matrix = np.array([frame["v"].iloc[i] for i in order], dtype=np.int64).reshape(len(order), int(key[1]))
        out = {
            "block": key[0], "dims": key[1], "n": len(order), "ids": ids[order].tobytes(), "rows": frame["row"].to_numpy(dtype=np.int64)[order].tobytes(),
            "labels": frame["label"].to_numpy(dtype=np.int64)[order].tobytes(),
            "residues": np.array([balanced(matrix, p) for p in primes[int(key[1])]], dtype=np.int16).tobytes(),
        }
        if with_positives:
            held = [frame["positives"].iloc[i] for i in order]
            out["positives"] = [[{"rank": x["rank"], "id": x["id"], "score": x["score"]} for x in h] for h in held]
        return pd.DataFrame([out])

    made = "block int, dims int, n int, ids binary, rows binary, labels binary, residues binary"
    if with_positives:
        made += ", positives array<array<struct<rank:int,id:long,score:long>>>"
    return stage(dealt.groupBy("block", "dims").applyInPandas(gather, made))


def _number(blocks: DataFrame) -> int:
    n = blocks.agg(F.max("block")).first()[0]
    return 1 if n is None else n + 1


def _tiles(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of rows with each block of anchors of as many dimensions.

    All pairs of partitions, so a task reads its own blocks from the shared folder: a join by numbers of blocks would copy the anchors for
    each block of rows, and send all copies through the driver where the anchors alone look small.
    """
    asked = anchors.select("dims", *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("dims", "block")))
    asked = asked.repartition(-(-_number(anchors) // WAVE)).hint("shuffle_replicate_nl")
    return blocks.repartition(min(_number(blocks), 10_000), "block").join(asked, "dims")


def _each_tile(batches: Iterator[pa.RecordBatch], primes: dict[int, list[int]]) -> Iterator[tuple]:
    """Per strip of anchors: their places, the tile, and the scores of all rows of the block."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            mine = primes[r["dims"]]
            whole = {}
            for side, count in (("", r["n"]), ("a_", r["a_n"])):
                for c in ("ids", "rows", "labels"):
                    whole[side + c] = np.frombuffer(r[f"{side}{c}"], dtype=np.int64)
                whole[side + "m"] = np.frombuffer(r[f"{side}residues"], dtype=np.int16).reshape(len(mine), count, r["dims"]).astype(np.float32)
            for at in range(0, r["a_n"], STRIP):
                strip = range(at, min(at + STRIP, r["a_n"]))
                yield strip, whole, scores(whole["a_m"][:, at : at + STRIP], whole["m"], mine), r.get("a_positives")


_FOUND = pa.schema([
    ("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])
_FOUND_DDL = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, vec_id long, score long"


def _id(value: int) -> int | None:
    return None if value == _NONE else value


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest per key, ties by smaller id, then by row."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from the rows of ``usable``.

    For each anchor and each of its first ``positives`` other rows of the same label: the first ``negatives`` rows of other labels with
    ``window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score``, highest score first, ties by smaller id, null ids last.
    Rows that repeat an id are rows of their own. Vectors only meet those of as many dimensions.
    """
    rows = stage(rows)
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    bounds = rows.groupBy(F.size("v").alias("dims")).agg(F.max(squares).alias("most")).collect()  # one row per number of dimensions
    primes = {r["dims"]: primes_for(r["most"] or 0, r["dims"]) for r in bounds}
    low, high = window

    def positives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strip, t, s, _ in _each_tile(batches, primes):
            out = []
            for line, a in zip(s, strip):
                alike = np.flatnonzero((t["labels"] == t["a_labels"][a]) & (t["rows"] != t["a_rows"][a]))
                for j in alike[first(line[alike], positives)]:
                    out.append((int(t["a_rows"][a]), _id(int(t["a_ids"][a])), None, None, None, int(t["rows"][j]), _id(int(t["ids"][j])), int(line[j])))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, x)) for x in out], _FOUND)

    def negatives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strip, t, s, held in _each_tile(batches, primes):
            out = []
            for line, a in zip(s, strip):
                other = np.flatnonzero(t["labels"] != t["a_labels"][a])
                order = other[np.argsort(-line[other], kind="stable")]
                falling = -line[order]
                for p in held[a]:
                    # The window as whole scores: up from the lower bound, down from the upper one.
                    least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                    start, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    for j in order[start : min(end, start + negatives)]:
                        out.append((int(t["a_rows"][a]), _id(int(t["a_ids"][a])), p["rank"], p["id"], p["score"], int(t["rows"][j]), _id(int(t["ids"][j])), int(line[j])))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, x)) for x in out], _FOUND)

    blocks = _blocks(rows, block_rows, primes)
    anchors = rows.where(is_anchor)
    near = _best(_tiles(blocks, _blocks(anchors, block_anchors, primes)).mapInArrow(positives_of, _FOUND_DDL), ["anchor"], positives)
    lists = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("vec_id").alias("id"), "score"))).alias("positives"))
    asked = stage(anchors.join(lists, anchors["row"] == lists["anchor"]).drop("anchor"))
    far = _best(_tiles(blocks, _blocks(asked, block_anchors, primes)).mapInArrow(negatives_of, _FOUND_DDL), ["anchor", "place"], negatives)
    return far.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled() -> Column:
    """The label that a row goes by: where the id is divisible by 7, the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
