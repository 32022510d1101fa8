"""Benchmark decontamination: windows of a benchmark item's size, exact check.

1. A window can only reach the similarity with an item if it holds one of the item's shingles, so windows are laid where a document
   has shingles of the benchmark: each lies as the item would if the common shingle stood at the same place in both.
2. Windows and items get SimHash fingerprints of their shingles. Eight blocks of eight bits, items listed under all values that differ in up to
   two bits of a block, find every pair within ``RADIUS`` bits: of 23 differing bits, some block has two at most.
3. These pairs are compared exactly: sum of the smaller by sum of the larger weights over all shingles.
4. Pairs at the similarity differ in ten of 64 bits on average, so few lie beyond the radius, but some may. The items that laid a window and are not
   near its fingerprint are compared with it exactly as well, which makes the result whole.

Columns and joins only. Documents are read twice: for the places of benchmark shingles, and for the words of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import only_ids, side
from shelfscope.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
_WIDTH = BITS // BLOCKS


def words_of(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str, k: int = SHINGLE) -> Column:
    """Each run of ``k`` words, repeats included; all words of a shorter text; none of an empty one."""
    whole = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, k)))
    return F.when(F.size(words) >= k, runs).otherwise(whole)


def simhash(hashes: str) -> Column:
    """Bit b is set if it is set in over half of the hashes; 0 for none."""
    # One pass over the list counts bits b and b + 32, in the two halves of a number.
    count = f"aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, b) & 4294967297L))"
    low, high = (f"IF({c} * 2 > size({hashes}), shiftleft(1L, b + {at}), 0L)" for c, at in (("(c & 4294967295L)", 0), ("shiftrightunsigned(c, 32)", 32)))
    return F.expr(f"aggregate(sequence(0, 31), 0L, (bits, b) -> bits | transform(array({count}), c -> {low} | {high})[0])")


def _block(fingerprint: str, number: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(fingerprint), (number * _WIDTH).cast("int")).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a window and an item of its size whose fingerprints differ in at most RADIUS bits; all of them, each once."""
    slack = RADIUS // BLOCKS
    near = F.array(*(F.lit(x) for x in range(1 << _WIDTH) if x.bit_count() <= slack))
    numbers = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    listed = items.select("item_id", "size", "item_print", F.explode(numbers).alias("block"))
    listed = listed.select("item_id", "size", "item_print", "block", F.explode(near).alias("flip"))
    listed = listed.select("item_id", "size", "item_print", "block", _block("item_print", F.col("block")).bitwiseXOR(F.col("flip")).alias("value"))
    asked = windows.select("doc_id", "start", "size", "print", F.explode(numbers).alias("block"))
    asked = asked.select("doc_id", "start", "size", "print", "block", _block("print", F.col("block")).alias("value"))
    met = asked.join(side(listed), ["size", "block", "value"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("doc_id", "start", "size", "item_id").distinct()


def find(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, size, similarity): each item a document holds, with its best and then first window, places in words.

    Rows that share an id count as one document; a null id is an id. Items and texts without words match nothing; items shorter than a
    shingle are one shingle. Equal items are found each. Benchmark rows are sent to executors only if they were counted to be few.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = (
        benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.size("words").alias("size"), shingles("words").alias("shingles"))
        .select("item_id", "size", "shingles", F.transform("shingles", lambda s: F.xxhash64(s)).alias("hashes"))
    )
    items = stage(items.distinct())
    places = items.select("item_id", "size", F.posexplode("hashes").alias("place", "hash"))
    known = side(places.select("hash").distinct())
    # Documents and items with fewer words than a shingle have one, at place 0.
    hits = (
        own.select("doc_id", words_of(F.col("text")).alias("words"))
        .select("doc_id", F.transform(shingles("words"), lambda s: F.xxhash64(s)).alias("hashes"))
        # Outer, so that no filter on the hashes is derived and evaluated before the words are: the join drops empty texts anyway.
        .select("doc_id", F.posexplode_outer("hashes").alias("at", "hash"))
        .join(known, "hash")
    )
    hits = stage(hits.select("doc_id", "at", "hash"))
    # An item's shingles, rarest in the corpus first, up to more than the share of its weight that a match may lack: a match holds one of
    # them. Items that a document shares only frequent phrases with give no windows.
    common = side(stage(hits.groupBy("hash").agg(F.count("*").alias("n"))))
    ranked = places.join(common, "hash", "left").groupBy("item_id", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash"))).alias("all"))
    spare = F.ceil((F.size("all") * (1 - similarity)) + 1e-9).cast("int")
    prefix = ranked.select("item_id", F.explode(F.array_distinct(F.slice(F.transform("all", lambda x: x["hash"]), 1, spare))).alias("hash"))
    likely = hits.join(side(prefix), "hash").select("doc_id", "item_id").distinct()
    held = likely.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")).join(hits, F.col("d").eqNullSafe(hits["doc_id"])).select("d", "i", "at", "hash")
    where = side(places.withColumnRenamed("hash", "h"))
    laid = held.join(where, (held["hash"] == where["h"]) & held["i"].eqNullSafe(where["item_id"]))
    pairs = stage(laid.select(F.col("d").alias("doc_id"), "item_id", "size", F.greatest(F.col("at") - F.col("place"), F.lit(0)).alias("start")).distinct())
    starts = pairs.select("doc_id", "size", "start").distinct()
    texts = only_ids(own, starts.select("doc_id")).select(F.col("doc_id").alias("id"), words_of(F.col("text")).alias("all"))
    # A text meets the list of its windows once; equal windows of a text are one, told by the first, which the same items laid.
    laid_out = starts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("at"))
    cut = F.transform("at", lambda w: F.struct(w["start"].alias("start"), w["size"].alias("size"), F.slice("all", w["start"] + 1, w["size"]).alias("words")))
    windows = stage(
        texts.join(laid_out, texts["id"].eqNullSafe(laid_out["doc_id"]))
        .select("doc_id", F.explode_outer(cut).alias("w"))
        .select("doc_id", "w.*")
        .groupBy("doc_id", "size", "words")
        .agg(F.min("start").alias("start"))
        .select("doc_id", "size", "start", shingles("words").alias("shingles"))
        .withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
        .withColumn("print", simhash("hashes"))
        .drop("hashes")
    )
    items = stage(items.withColumn("item_print", simhash("hashes")))
    close = within_radius(windows.select("doc_id", "start", "size", "print"), items.select("item_id", "size", "item_print"))
    of = [F.col(c).alias(f"{c}_") for c in ("doc_id", "start", "size", "item_id")]
    near = close.select(*of)
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("start") == F.col("start_")) & (F.col("size") == F.col("size_"))
    near = stage(near)
    found = _compared(pairs.join(near, same, "left_semi"), windows, items, similarity)
    rest = _compared(pairs.join(near, same, "left_anti"), windows, items, similarity)
    return (
        found.unionByName(rest)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best"))
        .select("doc_id", "item_id", (-F.col("best.back")).alias("start"), F.col("best.size").alias("size"), F.col("best.similarity").alias("similarity"))
    )


def _compared(pairs: DataFrame, windows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The pairs (doc_id, item_id, start, size) of a window and an item that reach the similarity by the shingles themselves."""
    w = windows.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("size").alias("z"), "shingles")
    met = pairs.join(w, pairs["doc_id"].eqNullSafe(w["d"]) & (pairs["start"] == w["s"]) & (pairs["size"] == w["z"]))
    item_shingles = side(items.select(F.col("item_id").alias("i"), F.col("size").alias("z"), F.col("shingles").alias("wanted")))
    met = met.join(item_shingles, met["item_id"].eqNullSafe(item_shingles["i"]) & (met["size"] == item_shingles["z"]))
    compared = met.select("doc_id", "item_id", "start", "size", weighted_similarity("shingles", "wanted").alias("similarity"))
    return compared.where(F.col("similarity") >= similarity)


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of smaller by sum of larger counts over the shingles of two lists.

    The n-th copy of a shingle is told from the first by its number, which makes lists sets: the common elements of the numbered lists
    are the sum of the smaller counts.
    """
    common = F.size(F.array_intersect(_numbered(a), _numbered(b)))
    return common / (F.size(a) + F.size(b) - common)


def _numbered(shingled: str) -> Column:
    """Each shingle with the number of equal ones before it; only lists with repeats need the count."""
    items = F.col(shingled)
    counted = F.transform(items, lambda s, i: F.concat_ws("\u0001", s, F.size(F.filter(F.slice(items, 1, i), lambda x: x == s)).cast("string")))
    plain = F.transform(items, lambda s: F.concat_ws("\u0001", s, F.lit("0")))
    return F.when(F.size(F.array_distinct(items)) == F.size(items), plain).otherwise(counted)
