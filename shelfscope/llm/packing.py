"""Best-fit packing of documents into token windows, under conflicts.

Documents are cut into pieces no longer than a bin. Pieces are dealt into groups of bounded size by a hash, and each group is packed by
itself, largest piece first: of the bins that can take a piece, it goes to the one with the least room, then the oldest. A bin cannot take a
piece if it holds one of the same cluster of copies, or already the allowed number of pieces of the same source.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import simhash_dedup
from shelfscope.session import stage

CAPACITY = 4096
#: Pieces of one source that a bin may hold.
SOURCE_LIMIT = 4
#: Pieces of a group, about; a group is one task's work and fits its memory at any input size.
GROUP_PIECES = 4000
PACKED = "bin_group int, bin long, place int, room int"


class Bins:
    """Open bins ordered by room, each with its conflict bitmap.

    Bit sets are whole numbers. A bin's bitmap holds one bit per cluster in it, and for each source as many planes of bits as the bin
    may hold pieces of it: a piece sets the first plane that is free, and the last plane tells that the source is used up. Bins of equal
    room and bitmap form a stack, so a thousand bins that all hold the same cluster are passed over in one step.
    """

    def __init__(self, capacity: int, source_limit: int):
        self.capacity, self.limit, self.made = capacity, source_limit, 0
        self.rooms = 0  # bit r: some bin has room r
        self.stacks: dict[int, dict[tuple[int, ...], list[int]]] = {}

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, room before) for a piece; source and cluster are bit sets, empty where there is nothing to conflict with."""
        above = self.rooms >> size << size
        while above:
            room = (above & -above).bit_length() - 1  # the tightest room that is left to try
            fits = [(stack[0], mark) for mark, stack in self.stacks[room].items() if not (mark[0] & cluster or mark[-1] & source)]
            if fits:
                number, mark = min(fits)
                self._take(room, mark)
                self._add(room - size, number, self._marked(mark, source, cluster))
                return number, room
            above &= above - 1
        number, self.made = self.made, self.made + 1
        self._add(self.capacity - size, number, self._marked((0,) * (self.limit + 1), source, cluster))
        return number, self.capacity

    def _marked(self, mark: tuple[int, ...], source: int, cluster: int) -> tuple[int, ...]:
        planes = list(mark[1:])
        for i, plane in enumerate(planes):
            if not plane & source:
                planes[i] |= source
                break
        return (mark[0] | cluster, *planes)

    def _take(self, room: int, mark: tuple[int, ...]) -> None:
        heappop(self.stacks[room][mark])
        if not self.stacks[room][mark]:
            del self.stacks[room][mark]
        if not self.stacks[room]:
            del self.stacks[room]
            self.rooms ^= 1 << room

    def _add(self, room: int, number: int, mark: tuple[int, ...]) -> None:
        if room:  # a full bin is closed
            heappush(self.stacks.setdefault(room, {}).setdefault(mark, []), number)
            self.rooms |= 1 << room


def pack_group(pieces: pd.DataFrame, capacity: int, source_limit: int) -> pd.DataFrame:
    """``pieces`` (size, source, cluster and others) with bin, place within the bin and room left after it."""
    pieces = pieces.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
    copies = pieces["cluster"].value_counts()
    bit_of = {c: i for i, c in enumerate(copies[copies > 1].index)}  # a cluster with one member here conflicts with nothing
    source_bit = {s: i for i, s in enumerate(pieces["source"].dropna().unique())}
    bins, got = Bins(capacity, source_limit), []
    held: dict[int, int] = {}
    for size, source, cluster in zip(pieces["size"], pieces["source"], pieces["cluster"]):
        number, room = bins.put(int(size), 1 << source_bit[source] if source in source_bit else 0, 1 << bit_of[cluster] if cluster in bit_of else 0)
        held[number] = held.get(number, -1) + 1
        got.append((number, held[number], room - int(size)))
    return pieces.assign(bin=[g[0] for g in got], place=[g[1] for g in got], room=[g[2] for g in got])


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), "")


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n, cluster) per row of ``docs``: its length in words and an end mark, and what near copies have in common.

    Clusters are the components of fingerprints (``simhash_dedup``), over all rows; rows without an id or a text have one as well.
    """
    row = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.size(_words(text_col)) + 1).alias("n"))
    prints = simhash_dedup.fingerprints(docs.select(row.alias("_doc"), F.col(text_col).alias("_text")), id_col="_doc", text_col="_text")
    found = simhash_dedup.classes(stage(prints))
    return found.select("doc_id.*", F.xxhash64("component_id").alias("cluster"))


def pieces_of(docs: DataFrame, capacity: int, id_col: str, text_col: str, source_col: str, length=None, cluster=None) -> DataFrame:
    """(doc_id, source, cluster, piece, start, size): each document cut at multiples of the capacity.

    ``length`` is a column or expression that counts a document's tokens, by default its words and an end mark; ``cluster`` one that
    names its cluster of copies, by default a hash of its words.
    """
    words = _words(text_col)
    length = (F.size(words) + 1) if length is None else length
    cluster = F.xxhash64(F.array_join(words, " ")) if cluster is None else cluster
    cut = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("n")
    )
    last = F.floor((F.col("n") - 1) / capacity).cast("int")
    return cut.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("size"),
    )


def pack(
    docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length=None, cluster=None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start (tokens before it in its document), size, bin_group, bin, place, room (left after it).

    No piece is dropped: one without a compatible bin opens a bin. A null or empty text is one token, its end mark. A null source
    conflicts with nothing; equal texts conflict, repeated rows too. Bins are told by group and number. Only lengths, sources and
    hashes are shuffled; they pass once through the shared scratch folder.
    """
    # A number of its own deals out equal rows too, whatever share of the table they are.
    pieces = stage(pieces_of(docs, capacity, id_col, text_col, source_col, length, cluster).withColumn("row", F.monotonically_increasing_id()))
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)).cast("int")).drop("row")
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = pack_group(pd.concat(list(frames)), capacity, source_limit)
        yield out[["doc_id", "piece", "start", "size", "bin_group", "bin", "place", "room"]]

    return dealt.groupBy("bin_group").applyInPandas(run, f"doc_id {kind}, piece int, start long, size int, {PACKED}")
