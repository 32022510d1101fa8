"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow a grammar.

The grammar is ``(s? (ua)+)?`` over role initials, read by an LR automaton. All ways to edit the rows read so far are one graph-structured
stack: stacks share their lower parts, and of equal stack tops only the one of least (cost, audit) stays. That loses nothing: what may follow
depends on the top alone, and of two edits of the same rows at the same cost neither audit is the beginning of the other (an insertion more
would cost more), so the smaller one stays smaller whatever follows.

Rows are sorted by ranges of (conversation, turn), so a conversation of any length is spread over partitions. One that lies whole within a
partition is repaired there. Of the others every piece of at most ``PIECE_ROWS`` rows is repaired from each stack it may start with, all pieces
at once, and a last pass strings the pieces of a conversation together; it holds the pieces whose edits are still open, a few at a time.
SHA-256 is sequential by definition, so that pass also hashes, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.session import stage

#: What edits cost; an undeleted truncated row costs TRUNCATED on top.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Most rows and bytes of text that are repaired in one piece.
PIECE_ROWS, PIECE_BYTES = 2_000, 4_000_000
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

# The automaton of  C -> nothing | T | s T,  T -> u a | T u a.  States 6 and 7 have read a rule to its end.
SHIFT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 4, (5, "u"): 4, (3, "a"): 6, (4, "a"): 7}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 2, 1: 5}
ACCEPT = (0, 2, 5)
START = (0, None)

Stack = tuple  # (state, the stack below)
Tops = dict[int, tuple[int, str, Stack]]  # by state of the top: cost, audit, stack


@cache
def shift(stack: Stack, symbol: str) -> Stack | None:
    """The stack after ``symbol`` and all reductions; None where the grammar does not allow it."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _reachable() -> list[Stack]:
    found = [START]
    for stack in found:
        found += [s for s in (shift(stack, c) for c in "sua") if s and s not in found]
    return found


STACKS = _reachable()


def _offer(tops: Tops, cost: int, audit: str, stack: Stack | None) -> bool:
    """Merge by top: the least (cost, audit) stays."""
    if stack is None or stack[0] in tops and tops[stack[0]][:2] <= (cost, audit):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def with_inserts(tops: Tops) -> Tops:
    """All stacks that rows without text lead to as well. Each costs more than what it came from, so this ends."""
    tops, todo = dict(tops), list(tops.values())
    for cost, audit, stack in todo:
        for symbol in ROLES:
            new = shift(stack, symbol)
            if _offer(tops, cost + INSERT, audit + "I", new):
                todo.append(tops[new[0]])
    return tops


def read_row(tops: Tops, initial: str, fault: str) -> Tops:
    """One row further: delete, keep or rerole it on every stack, after any insertions."""
    out: Tops = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for cost, audit, stack in with_inserts(tops).values():
        _offer(out, cost + DELETE, audit + "D", stack)
        if fault not in ("blank", "duplicate"):
            if initial in ("s", *ROLES):
                _offer(out, cost + extra, audit + "K", shift(stack, initial))
            for symbol in ROLES:
                _offer(out, cost + REROLE + extra, audit + "R", shift(stack, symbol))
    return out


def read_rows(rows: list[tuple[str, str]], start: Stack = START) -> Tops:
    tops: Tops = {start[0]: (0, "", start)}
    for initial, fault in rows:
        tops = read_row(tops, initial, fault)
    return tops


def accepted(tops: Tops) -> tuple[int, str]:
    return min(t[:2] for state, t in with_inserts(tops).items() if state in ACCEPT)


def faults(rows: list[tuple], seen: set) -> list[str]:
    """The first fault of each (turn, role, text, mark) or ""; ``seen`` holds (role, mark) of earlier rows and takes up these."""
    out = []
    for _, role, text, mark in rows:
        body = text.strip(SPACE)
        again = (role, mark) in seen
        seen.add((role, mark))
        out.append("blank" if not body else "duplicate" if again else "" if body[-1] in ".!?" else "truncated")
    return out


def repaired(rows: list[tuple], audit: str, last: str = "") -> tuple[list[str], str]:
    """``role:text`` of the rows after the edits of ``audit``, and the last role's initial; ``last`` is the one before them."""
    out, at = [], 0
    for edit in audit:
        wanted = "a" if last == "u" else "u"
        if edit == "I":
            out.append(f"{ROLES[wanted]}:")
            last = wanted
            continue
        _, role, text, _ = rows[at]
        at += 1
        if edit != "D":
            last = role[:1] if edit == "K" else wanted
            out.append(f"{role if edit == 'K' else ROLES[wanted]}:{text}")
    return out, last


def figures(rows: list[tuple], found: list[str]) -> dict:
    """What is counted over rows in order; two of these add up by ``joined_figures``."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "distinct": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def joined_figures(a: dict, b: dict) -> dict:
    """Figures of rows ``a`` with the rows ``b`` behind them, in order of turns."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in LEGAL
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    for name, (x, y) in {"low": (a, b), "first": (a, b), "high": (b, a), "last": (b, a)}.items():
        out[name] = x[name] if x[name] is not None else y[name]
    return out


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def result(f: dict, cost: int, audit: str, digest: str) -> dict:
    gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["distinct"]
    return {"gaps": gaps, **{k: f[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def repair_whole(rows: list[tuple]) -> dict:
    """One conversation, its rows (turn, role, text, mark) in order."""
    found = faults(rows, set())
    cost, audit = accepted(read_rows([(r[1][:1], f) for r, f in zip(rows, found)]))
    return result(figures(rows, found), cost, audit, hashlib.sha256("\n".join(repaired(rows, audit)[0]).encode()).hexdigest())


_ARRAYS = {"turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "marks": pa.list_(pa.string())}
_PIECE = "piece long, turns array<long>, roles array<string>, texts array<string>, marks array<string>"
_RESULT_TYPES = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), *_ARRAYS.items(), *_RESULT_TYPES])


def _batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names}], schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: conversations that lie whole in it are repaired, of all others come pieces."""
    number, held = TaskContext.get().partitionId() << 32, 0
    rows, size, conv, is_open = [], 0, None, True  # what the partition begins with may have begun before it
    done, started = [], False

    def piece() -> pa.RecordBatch:
        nonlocal rows, size, held
        turns, roles, texts, marks = ([r[i] for r in rows] for i in range(4))
        out = {"conv_id": conv, "piece": number + held, "turns": turns, "roles": roles, "texts": texts, "marks": marks}
        held, rows, size = held + 1, [], 0
        return _batch(out, _PIECES)

    for b in batches:
        for c, turn, role, text, mark, gone in zip(*(b.column(i).to_pylist() for i in range(6))):
            if started and c != conv:
                if is_open:
                    yield piece()
                else:
                    done.append({"conv_id": conv, **repair_whole(rows)})
                    rows, size = [], 0
                is_open = False
            conv, started = c, True
            if not gone:
                rows.append((turn, role, text, mark))
                size += len(text)
            if len(rows) >= PIECE_ROWS or size >= PIECE_BYTES:
                is_open = True
                yield piece()
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECES)
            done = []
    if started:  # it may go on in the next partition
        yield piece()


_TRANSFERS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_FIGURES = pa.struct(
    [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")] + [("first", pa.string()), ("last", pa.string())]
)
_OPEN = pa.schema([("who", pa.string()), ("conv_id", pa.int64()), ("piece", pa.int64()), ("roles", _ARRAYS["roles"]), ("texts", _ARRAYS["texts"]), ("transfers", _TRANSFERS), ("figures", _FIGURES)])
_OPEN_DDL = (
    "who string, conv_id long, piece long, roles array<string>, texts array<string>, transfers array<struct<start:int,end:int,cost:long,audit:string>>, "
    "figures struct<blank:long,duplicate:long,truncated:long,illegal:long,distinct:long,low:long,high:long,first:string,last:string>"
)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's least edits from every stack to every top, and its figures."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            rows = list(zip(r["turns"], r["roles"], r["texts"], r["marks"]))
            found = faults(rows, {(s["role"], s["mark"]) for s in r["before"] or []})
            symbols = [(row[1][:1], f) for row, f in zip(rows, found)]
            ways = [
                {"start": k, "end": STACKS.index(stack), "cost": cost, "audit": audit}
                for k, start in enumerate(STACKS)
                for cost, audit, stack in read_rows(symbols, start).values()
            ]
            yield _batch(r | {"transfers": ways, "figures": figures(rows, found)}, _OPEN)


class _Joined:
    """A conversation put together from its pieces in order."""

    def __init__(self):
        self.figures = figures([], [])
        self.ways = {0: (0, [])}  # by stack: cost, and (stack, audit) after each piece that is still open
        self.open: list[list[tuple]] = []
        self.audit: list[str] = []
        self.last, self.hash, self.any = "", hashlib.sha256(), False

    def add(self, r: dict) -> None:
        self.figures = joined_figures(self.figures, r["figures"])
        tops: dict[int, tuple] = {}
        for t in r["transfers"]:
            if t["start"] in self.ways:
                cost, path = self.ways[t["start"]]
                cost, path, state = cost + t["cost"], [*path, (t["end"], t["audit"])], STACKS[t["end"]][0]
                if state not in tops or (cost, self._text(path)) < (tops[state][0], self._text(tops[state][1])):
                    tops[state] = (cost, path)
        self.ways = {path[-1][0]: (cost, path) for cost, path in tops.values()}
        self.open.append([(None, role, text, None) for role, text in zip(r["roles"], r["texts"])])
        paths = [path for _, path in self.ways.values()]
        while self.open and all(p[0] == paths[0][0] for p in paths):  # decided: all ways begin alike
            self._write(paths[0][0][1])
            for p in paths:
                p.pop(0)

    @staticmethod
    def _text(path: list) -> str:
        return "".join(audit for _, audit in path)

    def _write(self, audit: str) -> None:
        said, self.last = repaired(self.open.pop(0) if self.open else [], audit, self.last)
        self.audit.append(audit)
        for s in said:
            self.hash.update(("\n" if self.any else "").encode() + s.encode())
            self.any = True

    def finish(self) -> dict:
        best = None
        for number, (cost, path) in self.ways.items():
            stack = STACKS[number]
            more, inserted = min((t[:2] for s, t in with_inserts({stack[0]: (0, "", stack)}).items() if s in ACCEPT), default=(0, ""))
            if best is None or (cost + more, self._text(path) + inserted) < (best[0], self._text(best[1]) + best[2]):
                best = (cost + more, path, inserted)
        for _, audit in list(best[1]):
            self._write(audit)
        self._write(best[2])
        return result(self.figures, best[0], "".join(self.audit), self.hash.hexdigest())


_JOINED = pa.schema([("conv_id", pa.int64()), *_RESULT_TYPES])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place, each conversation read as a stream."""
    who, conv, joined = None, None, None
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if joined is None or r["who"] != who:
                if joined is not None:
                    yield _batch({"conv_id": conv, **joined.finish()}, _JOINED)
                who, conv, joined = r["who"], r["conv_id"], _Joined()
            joined.add(r)
    if joined is not None:
        yield _batch({"conv_id": conv, **joined.finish()}, _JOINED)


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of (conv_id, turn, role, text).

    Rows count by turn, nulls first; rows of one turn by role and then by the MD5 of their text, so equal rows stand together. Null roles and
    texts are one space; a null conv_id is a conversation. Rows that ``gone`` names only make their conversation appear. Other columns are
    not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    ).withColumn("mark", F.md5("text")).withColumn("row", F.monotonically_increasing_id())
    # Equal rows are told apart by a number, so that even these are spread; which is which does not matter.
    order = ["conv_id", "turn", "role", "mark", "row"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "mark", "gone")
    cut = stage(ranged.mapInArrow(_cut, f"conv_id long, {_PIECE}, {RESULT}"))
    whole = cut.where("piece IS NULL").select("conv_id", *(n for n, _ in _RESULT_TYPES))
    pieces = cut.where("piece IS NOT NULL").withColumn("who", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    # What a piece repeats from an earlier one. Pieces are few: two of a partition, and one for every PIECE_ROWS rows of a long conversation.
    said = pieces.select("who", "piece", F.explode(F.arrays_zip("roles", "marks")).alias("x")).select("who", "piece", F.col("x.roles").alias("role"), F.col("x.marks").alias("mark"))
    said = said.distinct()
    first = said.groupBy("who", "role", "mark").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    before = said.join(first, ["who", "role", "mark"]).where("piece > first").groupBy("piece").agg(F.collect_list(F.struct("role", "mark")).alias("before"))
    joined = (
        pieces.join(before, "piece", "left")
        .select("who", "conv_id", "piece", "turns", "roles", "texts", "marks", "before")
        .mapInArrow(_transfers, _OPEN_DDL)
        .repartition("who")
        .sortWithinPartitions("who", "piece")
        .mapInArrow(_join, f"conv_id long, {RESULT}")
    )
    return whole.unionByName(joined)


DAMAGES = 20


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of ``conversations`` with faults by the CRC-32 of ``conv_id:turn``, and a condition for those that were dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(DAMAGES))
    said = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.alias("code")).select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("code") == 0).alias("dropped"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return rows.drop("col"), F.col("dropped")
