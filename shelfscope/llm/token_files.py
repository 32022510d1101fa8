"""Token ids as flat binary files.

A data set is a folder of parts in ascending order of ids. Part ``N`` has three files: ``part-N.bin`` holds the token ids of its documents one
after the other as little-endian unsigned integers, of 16 bits if every id of the vocabulary and the end id fit, else of 32; ``part-N.off`` holds, as little-endian unsigned 64-bit integers, where each of its
documents begins in the whole data set, and at last where the part ends; ``part-N.docs`` is an Arrow file of the documents' ids. ``_parts`` is a
Parquet table of part, documents, tokens, width (bytes of an id) and base (tokens of all parts before it).

Documents are sorted by range, so each task writes one part and only the counts of parts, one row each, are summed up for the bases. A
file is written under a name of its task's attempt and then moved: a task that runs twice leaves one whole file, with the same bytes.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = 1
COUNTS = "part int, docs long, tokens long, width int"
#: Chunks of text whose ids a worker remembers; rare ones go when there are more.
REMEMBERED = 1 << 20
#: Texts with blanks in all kinds of places: a vocabulary that keeps blanks in its pieces shows on them.
PROBES = ["Two words, and  more\nof them\n\n  it's 12 345 ", " a b", "x\n", "日本 語 é e\u0301 🙂 ."]
_tokenizers: dict[str, Encoder] = {}


def _chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Encoder:
    """The ids of a text as bytes, by a tokenizer file.

    Where white space only parts pieces and never enters them, a text may be cut at spaces and line ends and the ids of its chunks be
    put in a row. Chunks recur; each is encoded once while it is remembered. A text that may hold a special token is encoded whole, and
    so are all texts if the vocabulary gives a probe other ids when it is cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}  # how special tokens begin
        self.seen: dict[str, bytes] = {}
        self.width = 2 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else 4
        self.cuts = all(self.whole([t])[0] == b"".join(self.whole(_chunks(t))) for t in PROBES)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [None if not self.cuts or any(m in t for m in self.marks) else _chunks(t) for t in (t or "" for t in texts)]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list({c for own in cut if own for c in own}.difference(self.seen))
        self.seen.update(zip(new, self.whole(new)))
        ids = self.seen.__getitem__
        return [self.whole([t or ""])[0] if own is None else b"".join(map(ids, own)) for t, own in zip(texts, cut)]


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as executors need it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def _name(part: int, kind: str) -> str:
    return f"part-{part:06d}.{kind}"


def _map(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes: mapped where the file system is a local or mounted one, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def _write_ids(docs: DataFrame, uri: str, tokenizer: str, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, path = _folder(uri)
        coder = encoder(tokenizer)
        if end >= 1 << 8 * coder.width:
            raise ValueError("the end id is larger than the ids of the vocabulary's width")
        last = np.array([end], dtype=f"<u{coder.width}").tobytes()
        ids, lengths = [], []
        with fs.open_output_stream(f"{path}/_{own}.bin") as out:
            for b in batches:
                texts = b.column(1).to_pylist()
                for at in range(0, len(texts), 256):
                    coded = [c + last for c in coder.batch(texts[at : at + 256])]
                    out.write(b"".join(coded))
                    lengths += [len(c) // coder.width for c in coded]
                ids.append(b.column(0))
        if not lengths:
            fs.delete_file(f"{path}/_{own}.bin")
            return
        table = pa.table({"doc_id": pa.chunked_array(ids), "n_tokens": pa.array(lengths, pa.int64())})
        with fs.open_output_stream(f"{path}/_{own}.docs") as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        for kind in ("bin", "docs"):
            fs.move(f"{path}/_{own}.{kind}", f"{path}/{_name(part, kind)}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(lengths)], pa.int64()), "tokens": pa.array([sum(lengths)], pa.int64()), "width": pa.array([coder.width], pa.int32())})

    return docs.mapInArrow(run, COUNTS)


def _write_offsets(parts: DataFrame, uri: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _folder(uri)
        for b in batches:
            for r in b.to_pylist():
                lengths = pa.ipc.open_file(_map(fs, f"{path}/{_name(r['part'], 'docs')}")).read_all()["n_tokens"].to_numpy()
                starts = r["base"] + np.concatenate([[0], np.cumsum(lengths)])
                own = f"{path}/_{uuid.uuid4().hex}.off"
                with fs.open_output_stream(own) as out:
                    out.write(starts.astype("<u8").tobytes())
                fs.move(own, f"{path}/{_name(r['part'], 'off')}")
            yield b

    return parts.mapInArrow(run, parts.schema)


def _one_task_each(parts: DataFrame) -> DataFrame:
    return parts.repartitionByRange(max(1, parts.count()), "part")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as a data set below a new folder ``path``; returns its table of parts.

    ``path`` is on a file system that all executors share; ``tokenizer`` is the path of a file that all executors have. A null or empty
    text is the end id alone. Rows that share an id stand together, in the order of their texts; those without an id stand first. An
    empty table gives a data set without parts. Texts are shuffled once, by ranges of ids.
    """
    spark = docs.sparkSession
    uri = qualified(spark, path)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    in_order = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    counts = f"{path}/_counts"
    _write_ids(in_order, uri, tokenizer, end).write.parquet(counts)
    counted = spark.read.schema(COUNTS).parquet(counts)
    # One row per part: a few thousand at most, far below what one task sums up.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
    _write_offsets(_one_task_each(based), uri).write.parquet(f"{path}/_parts")
    return parts_of(spark, path)


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, base long").parquet(f"{path}/_parts")


def read(spark: SparkSession, path: str, id_type: str = "bigint", ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ``ids`` the array ids) of each document, from the files alone.

    ``ids_crc32`` is the checksum of the document's ids as little-endian unsigned 32-bit integers, whatever their width in the file. A part is one task; documents are slices of the mapped file.
    """
    uri = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _folder(uri)
        for b in batches:
            for part, width in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = lambda what, n=part: f"{folder}/{_name(n, what)}"
                tokens = np.frombuffer(_map(fs, at("bin")), dtype=f"<u{width}")
                starts = np.frombuffer(_map(fs, at("off")), dtype="<u8").astype(np.int64)
                docs = pa.ipc.open_file(_map(fs, at("docs"))).read_all()["doc_id"].combine_chunks()
                own = starts - starts[0]
                for first in range(0, len(docs), 1024):
                    bounds = list(zip(own[first : first + 1024], own[first + 1 : first + 1025]))
                    columns = [
                        docs.slice(first, 1024), pa.array(starts[first : first + len(bounds)]), pa.array([int(z - a) for a, z in bounds], pa.int64()),
                        pa.array([zlib.crc32(tokens[a:z].astype("<u4").tobytes()) for a, z in bounds], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array([tokens[a:z].astype(np.int64) for a, z in bounds], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<bigint>" if ids else ""
    return _one_task_each(parts_of(spark, path).select("part", "width")).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long{more}")
