"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, several times over. A document's virtual finish time is the number of words its
source has given by its end, divided by the source's target. Served by finish time, sources give words in proportion to their targets at
any moment; the mix is what is served before the budget is spent, so each source ends within a document of its target.

Sums run over rows sorted by ranges: each partition adds up its own rows, and what the partitions before it hold is added from one row per
partition. A source is therefore never one task's work, however large it is. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.llm.common import look_up, side
from shelfscope.session import stage

#: Weights of the sources by code point, repeating; most times that a document may count.
WEIGHTS, REPEATS = (1, 2, 3), 3
WORDS = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows up to this one in ``order``.

    ``order`` must tell rows apart that are not alike. ``value`` is a long without nulls.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType())])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            sums = total + np.cumsum(b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False), dtype=np.int64)
            if len(sums):
                total = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(b.columns)), pa.array(np.full(len(sums), part, dtype=np.int32)), pa.array(sums)], schema=arrow)

    summed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    # One row per partition.
    parts = summed.groupBy("_part").agg(F.max("_sum").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("_part", before.alias("_before")))
    return summed.join(parts, "_part").select(*rows.columns, (F.col("_before") + F.col("_sum")).alias(out))


def targets(sources: DataFrame, budget: int, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (…, weight, source_size) with target: shares of ``budget`` by weight, none above ``repeats`` times its size.

    What a source cannot take is shared among the others by weight, until none is above. A round is one aggregation.
    """
    sources = stage(sources.withColumn("full", F.lit(False)))
    while True:
        most = (repeats * F.col("source_size")).cast("double")
        free = sources.agg(F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("full"), repeats * F.col("source_size"))), F.lit(0))).first()
        share = F.lit(float(budget - free[1])) * F.col("weight") / F.lit(float(free[0] or 1))
        shared = stage(sources.withColumn("above", ~F.col("full") & (share > most)).withColumn("target", F.when(F.col("full"), most).otherwise(share)))
        if shared.where("above").isEmpty():
            return shared.drop("full", "above")
        sources = shared.withColumn("full", F.col("full") | F.col("above")).drop("above", "target")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", size: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``: how many of its words the mix takes, repeats counted.

    The mix has ``share`` of all words. Sources weigh ``weights``, repeating, in order of code points, a null source last. A null text is
    empty; documents without words take nothing, and a source of such documents has target 0. Rows are shuffled by the MD5 of
    their id, the same in each run; rows of one id and size are alike, and which of them is taken does not matter. Other columns are not read.
    """
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), 0)) if size is None else size
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"))
        # A name for the null source that no other source has.
        .withColumn("queue", F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source"))))
        .withColumn("last", F.col("source").isNull())
        .withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(" "))))
        .withColumn("row", F.monotonically_increasing_id())
    )
    sources = rows.groupBy("queue", "last").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = stage(sources.withColumn("one", F.lit(1).cast("long")))
    placed = running(sources, ["last", "queue"], "one", "place")
    placed = running(placed, ["place"], "source_size", "upto").withColumn("before", F.col("upto") - F.col("source_size"))
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    facts = stage(targets(placed.withColumn("weight", weight), budget, repeats).select("queue", "place", "before", "source_size", "target", "n"))

    summed = running(rows, ["last", "queue", "shuffle", "size", "row"], "size", "upto").drop("last", "source", "shuffle", "row")
    queued = stage(look_up(summed, facts, "queue", "n").withColumn("given", F.col("upto") - F.col("before")).drop("upto", "before", "queue"))
    # The copies that may be served: those that end by the target, and the one after.
    finish = lambda again: (again * F.col("source_size") + F.col("given")).cast("double") / F.col("target")
    offered = lambda again: again * F.col("source_size") + F.col("given") - F.col("size") <= F.col("target")
    served = (
        queued.where("size > 0 AND target > 0")
        .withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .where(offered(F.col("again")))
        .select(finish(F.col("again")).alias("finish"), "place", "given", "again", "size")
    )
    order = ["finish", "place", "given", "again"]
    sums = stage(running(served, order, "size", "spent"))
    end = sums.where(F.col("spent") <= budget).agg(F.max(F.struct(*order)).alias("end")).first()["end"]
    if end is None:
        return queued.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # What is served by the last one: finish times rise with each repeat, so a row's copies are counted without a join.
    last = F.struct(*(F.lit(end[c]).cast(sums.schema[c].dataType).alias(c) for c in order))
    own = lambda i: F.struct(finish(F.lit(i)).alias("finish"), "place", "given", F.lit(i).alias("again"))
    times = sum((F.when(offered(F.lit(i)) & (own(i) <= last), 1).otherwise(0) for i in range(repeats)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * times).otherwise(0).cast("long")
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
