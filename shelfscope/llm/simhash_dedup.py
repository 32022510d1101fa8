"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two bits of each other have a fingerprint within one bit of both. Each distinct fingerprint therefore emits itself and
its 64 neighbours, and fingerprints that share a variant meet. All that meet are within two bits of each other, so a chain through the
fingerprints of a variant links the same classes as all its pairs would; a variant has 65 fingerprints at most. Copies of a
fingerprint are one row before anything is emitted.

``near_copies`` finds all pairs of texts that share enough of their word shingles. Balls of fingerprints propose first and link most of each group.
What no ball may hold, a prefix filter completes: of two near texts, the rarest shingles, as many as may be lacking and one, have one in
common. Texts of different classes meet under these; numbers of shingles, places and sketches refuse pairs that cannot be near, the shares of
common shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import look_up, only_ids, side, without_ids
from shelfscope.llm.components import components
from shelfscope.session import stage, staged_alone

#: Words of a shingle, seed, and bits by which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Near copies: words of a shingle and least share of common shingles.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Buckets in which shingles are counted for their order, and bits of the sketch by which pairs are refused without their shingles.
BUCKETS, SKETCH_BITS = 1 << 18, 512
#: Texts of a shingle that meet in one piece of work, texts of a shingle in one chain, orders of chains, and pieces in which texts of a fingerprint are chained.
CELL, CHAIN, ORDERS, PIECES = (256, 4096), 4096, 32, 64
_BUCKET, _MIX = np.uint64(BUCKETS - 1), np.uint64(0x9E3779B97F4A7C15)
_SKETCH = [f"bits{i}" for i in range(SKETCH_BITS // 64)]
_BITS = np.arange(64, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words between white space (space and 0x09 to 0x0D), A-Z in lower case: what ``bytes`` does, letters beyond ASCII untouched."""
    return (text or "").encode().lower().split()


def shingles(own: list[bytes], k: int) -> list[bytes]:
    """Runs of ``k`` words; the whole sequence of a shorter text; none of an empty one."""
    if len(own) <= k:
        return [b" ".join(own)] if own else []
    joined, start, bounds = b" ".join(own), 0, []
    for w in own:
        bounds.append((start, start + len(w)))
        start += len(w) + 1
    return [joined[a:b] for (a, _), (_, b) in zip(bounds, bounds[k - 1 :])]


def hashes(grams, seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, seed) for g in grams), dtype=np.uint64)


def fingerprint(h: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Signed 64-bit number whose bits are those set in over half of the hashes, by weight; 0 for none."""
    if not len(h):
        return 0
    count, total = np.zeros(64, dtype=np.int64), len(h) if weights is None else int(weights.sum())
    for at in range(0, len(h), 65_536):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + 65_536] @ bits
    return int(((count * 2 > total).astype(np.uint64) << _BITS).sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) per row of ``docs``; a null text is an empty one."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(hashes(shingles(words(t), shingle), seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], ["doc_id", "print"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, print long")


def variants(prints: Column) -> Column:
    """A fingerprint and its 64 neighbours by one bit."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    return F.transform(flips, lambda f: prints.bitwiseXOR(f))


def chains(emitted: DataFrame, node: str) -> DataFrame:
    """(u, v): each node of a variant with the next one. A variant has few distinct fingerprints, and only chains leave it, not pairs."""
    return (
        emitted.selectExpr("variant", f"{node} AS u", f"lag({node}) OVER (PARTITION BY variant ORDER BY {node}) AS v")
        .where("v IS NOT NULL AND u <> v")
        .select("u", "v")
    )


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) from the rows of ``fingerprints``: the smallest id that can be reached over links.

    Ids without a value count for nothing; where no id is known, the component has none. Repeated rows repeat.
    """
    distinct = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_print")))
    emitted = distinct.select("print", F.explode(variants(F.col("print"))).alias("variant"))
    links = chains(emitted, "print").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    linked = components(links)
    labelled = distinct.join(linked, distinct["print"] == linked["node"], "left").select("print", "first", "n_print", F.coalesce("least", "print").alias("least"))
    labelled = stage(labelled)
    smallest = labelled.groupBy("least").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    # One row per fingerprint met one row per component, then documents met one row per fingerprint.
    named = look_up(labelled, stage(smallest), "least", "n").select("print", "n_print", "component_id")
    return look_up(prints, stage(named), "print", "n_print").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) per row of ``docs``; other columns are not read."""
    found = classes(stage(fingerprints(docs, SHINGLE, SEED, id_col, text_col)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def gram_set(own: list[bytes], k: int) -> np.ndarray:
    """Different hashes of the ``shingles`` of a text, sorted: a set, repeats do not count for the share."""
    if not own:
        return np.empty(0, dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(own)}
    each = np.fromiter(map(known.__getitem__, own), dtype=np.uint64, count=len(own))
    k = min(k, len(own))
    mixed = np.zeros(len(own) - k + 1, dtype=np.uint64)
    for i in range(k):
        mixed = (mixed + each[i : i + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the hashes in SKETCH_BITS buckets as signed words: two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((grams >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def rarest(grams: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rarest first: two sets that share ``similarity`` of their shingles have one of these in common.

    What order all texts follow does not matter for that; rare ones first keeps few texts to a shingle.
    """
    lead = len(grams) - int(np.ceil(similarity * len(grams) - 1e-9)) + 1
    return grams[np.lexsort((grams, often[(grams & _BUCKET).astype(np.int64)]))[:lead]]


def text_key(own: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(own))).astype(np.int64))


def near_copies(
    docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, copy_of) for each row that is linked to a smaller id: the smallest id of its group.

    Texts with the same words are copies. Different texts are linked if they share ``similarity`` of their shingles (common by all
    different ones); all such pairs count, directly or over a chain of them. Texts without words are copies of each other. Rows
    without an id take no part.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(BUCKETS, dtype=np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * len(_SKETCH), pa.list_(pa.int64())]
        names = ["doc_id", "same", "print", "size", *_SKETCH, "often"]
        for b in _short(batches):
            same, prints, size, bits = [], [], [], []
            for t in b.column(1).to_pylist():
                own = words(t)
                grams = gram_set(own, shingle)
                same.append(text_key(own))
                prints.append(fingerprint(grams))
                size.append(len(grams))
                bits.append(sketch(grams))
                np.add.at(often, (grams & _BUCKET).astype(np.int64), 1)
            columns = [b.column(0), same, prints, size, *np.array(bits, dtype=np.int64).reshape(-1, len(_SKETCH)).T, [None] * len(same)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
        held = np.flatnonzero(often)
        last = [[None], [None], [None], [None], *[[None]] * len(_SKETCH), [held << 32 | often[held]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(last, kinds)], names)

    both = stage(narrow.mapInArrow(run, f"doc_id long, same long, print long, size int, {', '.join(f'{c} long' for c in _SKETCH)}, often array<long>"))
    rows = both.where("doc_id IS NOT NULL")
    counted = both.where("doc_id IS NULL").select(F.explode("often").alias("x")).groupBy(F.expr("x >> 32").alias("bucket")).agg(F.sum(F.expr("x & 4294967295")).alias("n"))
    # One node per text, whatever ids share it.
    nodes = stage(rows.groupBy("same").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("print", "size", *_SKETCH)), F.count("*").alias("n")))

    def links() -> DataFrame:
        often = np.zeros(BUCKETS, dtype=np.int64)
        for r in counted.collect():
            often[r["bucket"]] = r["n"]
        posted = _posted(narrow, often, shingle, similarity)
        classes = spark.createDataFrame([], "node long, least long")
        # Only texts that no earlier proposal has linked are compared.
        proposals = (
            lambda known: _sketched(_unlinked(_balls(nodes.where("size > 0")).distinct(), known), nodes, similarity),
            lambda known: _sketched(_unlinked(_chained(posted, similarity).distinct(), known), nodes, similarity),
            lambda known: _between(posted, known, nodes, similarity),
        )
        for propose in proposals:
            near = propose(classes)
            found = staged_alone(spark, lambda near=near: _verified(near, nodes, narrow, shingle, similarity))
            linked = classes.select(F.col("node").alias("u"), F.col("least").alias("v")).union(found)
            if not found.isEmpty():
                classes = staged_alone(spark, lambda linked=linked: components(linked))
        return classes

    linked = staged_alone(spark, links)
    labelled = stage(nodes.join(linked, nodes["same"] == linked["node"], "left").select("same", "first", "n", F.coalesce("least", "same").alias("least")))
    smallest = stage(labelled.groupBy("least").agg(F.min("first").alias("copy_of"), F.count("*").alias("n_least")))
    named = look_up(labelled, smallest, "least", "n_least").select("same", "n", "copy_of")
    return look_up(rows.select("doc_id", "same"), stage(named), "same", "n").select("doc_id", "copy_of").where("copy_of < doc_id")


def _short(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a worker holds the texts of few rows as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _unlinked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of texts that are not in one class."""
    known = side(classes)
    of = lambda end: known.select(F.col("node").alias(end), F.col("least").alias(f"{end}_"))
    met = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return met.where(F.coalesce("u_", "u") != F.coalesce("v_", "v")).select("u", "v")


def _pair(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of texts whose fingerprints meet under a variant: chains of the texts of a fingerprint, and of one text each of those that meet."""
    alike = Window.partitionBy("print", F.pmod("same", F.lit(PIECES))).orderBy("same")
    within = nodes.select(F.col("same").alias("u"), F.lag("same").over(alike).alias("v")).where("v IS NOT NULL")
    distinct = nodes.groupBy("print").agg(F.min("same").alias("node"))
    met = chains(distinct.select("node", F.explode(variants(F.col("print"))).alias("variant")), "node")
    return within.select(*_pair(F.col("u"), F.col("v"))).union(met.select(*_pair(F.col("u"), F.col("v"))))


def _posted(texts: DataFrame, often: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(gram, same, size, pos, pieces): each text under its rarest shingles with their places, those that no other text is under left out.

    ``pieces`` is the number of chains the texts of a shingle are cut into.

    One exchange by shingle; nine in ten shingles stand alone and go there. Near copies share their shingles, so a group of them is spread over as
    many tasks as a text has rarest shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task post once

        def out() -> pa.RecordBatch:
            counts = [len(g) for g in lead]
            place = np.concatenate([np.arange(n, dtype=np.int64) for n in counts])
            columns = [np.concatenate(lead).astype(np.int64), np.repeat(np.array(same, dtype=np.int64), counts), np.repeat(np.array(size, dtype=np.int64) << 32, counts) | place]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "same", "at"])

        for b in _short(batches):
            same, size, lead, held = [], [], [], 0
            for t in b.column(1).to_pylist():
                own = words(t)
                key = text_key(own)
                if key in seen:
                    continue
                seen.add(key)
                grams = gram_set(own, shingle)
                if len(grams):
                    same.append(key)
                    size.append(len(grams))
                    lead.append(rarest(grams, often, similarity))
                    held += len(lead[-1])
                if held > 100_000:
                    yield out()
                    same, size, lead, held = [], [], [], 0
            if lead:
                yield out()

    under = Window.partitionBy("gram")
    postings = texts.mapInArrow(run, "gram long, same long, at long")
    met = postings.select("*", F.min("same").over(under).alias("a"), F.max("same").over(under).alias("b"), F.count("*").over(under).alias("k")).where("a <> b")
    # Copies in several tasks post several times.
    once = met.withColumn("before", F.lag("same").over(under.orderBy("same"))).where("before IS NULL OR before <> same")
    return stage(once.select("gram", "same", F.expr("at >> 32").cast("int").alias("size"), F.expr("at & 4294967295").cast("int").alias("pos"), F.ceil(F.col("k") / CHAIN).cast("int").alias("pieces")))


def _may_hold(similarity: float) -> Column:
    """Whether texts u and v that meet under a shingle may share enough of them, by their numbers and the places of the shingle.

    The first shingle that two near texts have in common passes: before it they share none, so what is left must do.
    """
    near = F.least("u.size", "v.size") >= similarity * F.greatest("u.size", "v.size") - 1e-9
    left = F.least(F.col("u.size") - F.col("u.pos"), F.col("v.size") - F.col("v.pos"))
    return near & (left >= (F.col("u.size") + F.col("v.size")) * (similarity / (1 + similarity)) - 1e-9)


def _alike(u: str, v: str, similarity: float) -> Column:
    """Whether two texts, structs with size and sketch, may share enough shingles; no pair that does is refused."""
    differ = sum((F.bit_count(F.col(f"{u}.{c}").bitwiseXOR(F.col(f"{v}.{c}"))) for c in _SKETCH), F.lit(0))
    both = F.col(f"{u}.size") + F.col(f"{v}.size")
    near = F.least(f"{u}.size", f"{v}.size") >= similarity * F.greatest(f"{u}.size", f"{v}.size") - 1e-9
    return near & (differ <= both * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _sketched(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that may share enough shingles by their numbers and sketches."""
    of = lambda side: nodes.select(F.col("same").alias(side), F.struct("size", *_SKETCH).alias(f"{side}_"))
    return pairs.join(of("u"), "u").join(of("v"), "v").where(_alike("u_", "v_", similarity)).select("u", "v")


def _chained(posted: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of each text with the next one under a shingle: links most of a large group at little cost.

    There are ``ORDERS`` orders, one to a shingle, so a text has about as many partners: were it one order, two neighbours that are not near would part
    a group. Where the texts of a shingle are cut into pieces, the first ones of the pieces are chained as well.
    """
    text = F.struct("same", "size", "pos")
    order = (F.xxhash64("same", F.pmod("gram", F.lit(ORDERS))), "same")
    by = Window.partitionBy("gram", F.pmod("same", F.col("pieces"))).orderBy(*order)
    within = posted.select("*", text.alias("u"), F.lag(text).over(by).alias("v"))
    firsts = within.where("v IS NULL AND pieces > 1").select("u", F.lag(text).over(Window.partitionBy("gram").orderBy(*order)).alias("v"))
    pairs = within.select("u", "v").union(firsts).where("v IS NOT NULL").where(_may_hold(similarity))
    return pairs.select(*_pair(F.col("u.same"), F.col("v.same")))


def _between(posted: DataFrame, classes: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of texts that meet under a shingle, may be near by their numbers, places and sketches and are in different classes.

    Under a shingle, texts outside the largest class meet all texts; where these are many, both sides are cut into pieces and each
    piece of one meets each piece of the other. Texts bring their sketches along: most that meet in a large group are not near, and
    these leave no row.
    """
    known = side(classes)
    named = posted.join(known, posted["same"] == known["node"], "left").select("gram", "same", "size", "pos", F.coalesce("least", "same").alias("class"))
    named = stage(named)
    per = named.groupBy("gram", "class").agg(F.count("*").alias("k"))
    per = per.groupBy("gram").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
    per = per.select("gram", "main", F.ceil(F.col("others") / CELL[0]).cast("int").alias("p"), F.ceil(F.col("n") / CELL[1]).cast("int").alias("q"))
    cut = stage(named.join(stage(per), "gram").join(nodes.select("same", *_SKETCH), "same"))
    text = F.struct("same", "size", "pos", "class", "main", *_SKETCH)
    piece = lambda n: F.pmod(F.xxhash64("same", "gram"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    u = cut.where("class <> main").select("gram", text.alias("u"), piece("p").alias("p"), all_of("q").alias("q"))
    v = cut.select("gram", text.alias("v"), piece("q").alias("q"), all_of("p").alias("p"))
    once = (F.col("v.class") == F.col("v.main")) | (F.col("u.same") < F.col("v.same"))
    pairs = u.join(v, ["gram", "p", "q"]).where((F.col("u.class") != F.col("v.class")) & once & _may_hold(similarity) & _alike("u", "v", similarity))
    return pairs.select(*_pair(F.col("u.same"), F.col("v.same"))).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) that share enough shingles. Only texts of some pair are cut into shingles again."""
    pairs = stage(pairs)
    asked = pairs.select(F.col("u").alias("same")).union(pairs.select("v")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _short(batches):
            own = [words(t) for t in b.column(1).to_pylist()]
            sets = [gram_set(w, shingle).astype(np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([pa.array(map(text_key, own), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["same", "grams"])

    ids = stage(nodes.join(asked, "same", "left_semi").select("first"))
    # An id may stand at other texts too, and at the same one again. Both sides of a pair are cut anew: cheaper than keeping the lists on disk.
    grams = only_ids(texts, ids).mapInArrow(run, "same long, grams array<long>")
    a = grams.select(F.col("same").alias("u"), F.col("grams").alias("a"))
    b = grams.select(F.col("same").alias("v"), F.col("grams").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    good = (common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9) & (F.size("a") + F.size("b") > 0)
    return pairs.join(a, "u").join(b, "v").where(good).select("u", "v").distinct()


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id; of rows that repeat an id, one stays.

    Rows without an id stay as they are.
    """
    drop = staged_alone(docs.sparkSession, lambda: near_copies(docs, id_col=id_col, text_col=text_col).select("doc_id"))
    kept = without_ids(docs, drop, id_col)
    repeated = stage(docs.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).select(id_col))
    if repeated.isEmpty():
        return kept
    return without_ids(kept, repeated, id_col).unionByName(only_ids(kept, repeated, id_col).dropDuplicates([id_col]))
