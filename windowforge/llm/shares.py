"""Searches of all rows by a stated set of queries: the rows are dealt to shares once, and the queries stream past every share.

A task holds one share at a time, whose size is bounded, and reads the queries in batches behind it. Rows are never copied; a query is sent once to each share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowforge.llm.common import column, n_partitions

#: Rows that a share has at most on average, and that it has at least before there are more shares than a few to a partition.
MOST_ROWS, LEAST_ROWS = 1 << 17, 1 << 11


def n_shares(total: int, partitions: int) -> int:
    return max(1, -(-total // MOST_ROWS), min(2 * partitions, -(-total // LEAST_ROWS)))


def past_shares(members: DataFrame, asking: DataFrame, total: int, build: Callable, answer: Callable, schema: str) -> DataFrame:
    """``answer(build(members of a share), batch of queries)`` for each share and all queries; both inputs have a ``row`` number, ``total`` is the number of members."""
    spark = members.sparkSession
    shares = n_shares(total, n_partitions(spark))
    left = members.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")).withColumn("kind", F.lit(0))
    right = asking.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).repartition(n_partitions(spark), "share").sortWithinPartitions("share", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            share, kind = column(b, "share"), column(b, "kind")
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(share) != 0) | (np.diff(kind) != 0)) + 1, [len(share)]]).tolist()
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if share[a] != own:
                    own, held, index = share[a], [], None
                if kind[a] == 0:
                    held.append(b.slice(a, z - a))
                elif held or index is not None:
                    if held:
                        index, held = build(pa.Table.from_batches(held).combine_chunks()), []
                    yield from answer(index, b.slice(a, z - a))

    return both.mapInArrow(run, schema)
