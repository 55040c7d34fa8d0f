"""Places in one order of all rows, without sorting them in one task, and running minima over such places.

Rows are dealt to tasks by ranges of their order and counted there; the counts of earlier tasks, a row for each task, are added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from windowforge.sources.scratch import staged

#: Places of a cell in which the rows of a node are sorted together, as a power of two.
CELL_BITS = 14


def counted(rows: DataFrame, order: list[str], flag: str) -> DataFrame:
    """Staged ``rows`` with before, the number of rows before them in this order whose ``flag`` (0 or 1) is 1, total, the number of all such rows, and others, of the rest."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.columns.index(flag)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            marks = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = seen + np.cumsum(marks)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(marks), part, np.int64)), pa.array(upto - marks)], [*b.schema.names, "part", "before"])
            seen = int(upto[-1]) if len(upto) else seen

    schema = StructType(rows.schema.fields).add("part", LongType()).add("before", LongType())
    kept = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(count, schema))
    sums = kept.groupBy("part").agg(F.sum(flag).alias("own"), F.count("*").alias("k"))  # a row for each task
    all_ = Window.partitionBy()
    total = F.sum("own").over(all_)
    earlier = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("earlier"), total.alias("total"), (F.sum("k").over(all_) - total).alias("others"))
    return kept.join(F.broadcast(earlier), "part").withColumn("before", F.col("before") + F.col("earlier")).drop("part", "earlier")


def nodes_of(place: str, side: str = "0"):
    """The dyadic nodes (side, level, node) that hold a place and that a prefix may ask: those to the left of another."""
    return F.expr(f"transform(filter(sequence(0, bits), l -> (shiftright({place}, l) & 1) = 0), l -> struct({side} AS side, l AS level, shiftright({place}, l) AS node))")


def nodes_before(size: str, side: str = "0"):
    """The dyadic nodes that together hold the places 0 .. size - 1: one for each bit of the size."""
    return F.expr(f"transform(filter(sequence(0, bits), l -> (shiftright({size}, l) & 1) = 1), l -> struct({side} AS side, l AS level, shiftright({size}, l) - 1 AS node))")


NODE = ["side", "level", "node"]


def running_minima(entries: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` (side, level, node, salt, key, ..) of nodes with from_key, to_key and whole.

    entries (side, level, node, salt, key, d, a, t) have keys that are places in an order of their own; from_key is the least ``d`` of the node's entries with
    their key at or above the asked one, to_key the least ``a`` of those with a key below, whole the least ``t`` of all. A node is sorted in cells of keys, so
    a large one is many tasks; what lies in a node's other cells comes from a table of its cells. Nodes that are asked often have copies, told apart by
    their salt.
    """
    values, more = ["d", "a", "t"], [c for c in asks.columns if c not in (*NODE, "salt", "key")]
    null = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    key = [*NODE, "salt"]
    both = entries.select(*key, "key", F.lit(1).alias("kind"), *values, *null(asks, more)).unionByName(asks.select(*key, "key", F.lit(0).alias("kind"), *null(entries, values), *more))
    both = both.withColumn("cell", F.shiftright("key", CELL_BITS))
    within = Window.partitionBy(*key, "cell")
    upto = lambda *order: within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_d", F.min("d").over(upto(F.desc("key"), F.desc("kind")))).withColumn("_a", F.min("a").over(upto("key", "kind"))).where("kind = 0")
    cells = both.groupBy(*key, "cell").agg(*[F.min(c).alias(c) for c in values])
    by = Window.partitionBy(*key).orderBy("cell")
    cells = cells.select(
        *key, "cell", F.min("d").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
        F.min("a").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("t").over(Window.partitionBy(*key)).alias("whole"),
    )
    out = own.drop(*values).join(cells, [*key, "cell"])
    return out.select(*asks.columns, F.least("_d", "later").alias("from_key"), F.least("_a", "earlier").alias("to_key"), "whole")
