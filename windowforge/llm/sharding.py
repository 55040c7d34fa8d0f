"""Sharding by extendible hashing.

Rows are placed by the leading bits of a hash. A bucket is parted on one more bit only while it exceeds the byte limit,
so the directory is deep just where the data are dense. Sums of all depths come from one histogram of hash prefixes
(a few rows per shard); only prefixes that are still too large are looked at again, some bits deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm.common import hand_over, stage, table

#: Bits of the hash: 15 hexadecimal digits.
BITS = 60


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_bytes): h from the id and the text, so only equal rows are inseparable."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", name, F.md5(text.cast("binary"))).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), F.octet_length(text).cast("long").alias("n_bytes"))


def _leaves(sums: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """For each prefix of ``depth`` bits: the depth of its bucket, or null if the bucket has to be parted deeper.

    ``sums`` (prefix, n_bytes, lo, hi) has the prefixes of unfinished buckets of ``top`` bits.
    """
    every = sums.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn("p", F.expr(f"shiftright(prefix, {depth} - d)"))
    fits = every.groupBy("d", "p").agg(F.sum("n_bytes").alias("total"), F.min("lo").alias("a"), F.max("hi").alias("b")).where((F.col("total") <= limit) | (F.col("a") == F.col("b"))).select("d", "p")
    found = every.join(fits, ["d", "p"], "left_semi").groupBy("prefix").agg(F.min("d").alias("depth"))
    return sums.select("prefix").join(found, "prefix", "left")


def shard_documents(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", bits_a_round: int = 8) -> DataFrame:
    """doc_id, n_bytes, depth and shard (its prefix bits, then the part of an overflowing bucket, 0 elsewhere).

    Only a document longer than ``limit`` exceeds it, alone with its equal rows dealt one to a part. A bucket of equal rows
    over the limit is cut into parts that fit. A null text has 0 bytes; a null id is an id of its own; an empty table gives no rows.
    """
    # equal rows over the limit are dealt by the piece of the input they come from, which is written down: a retried task finds it again
    rows = stage(hashed(docs, id_col, text_col).withColumn("salt", F.shiftright(F.monotonically_increasing_id(), 33).cast("int")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    top, open_rows, done, kept = 0, rows, None, [rows]
    while True:
        at = open_rows.withColumn("prefix", F.shiftright("h", BITS - depth))
        sums = at.groupBy("prefix").agg(F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        leaves = stage(_leaves(sums, top, depth, limit))
        kept.append(leaves)
        placed = at.join(leaves, "prefix").select("doc_id", "h", "n_bytes", "salt", "depth")
        closed = placed.where(F.col("depth").isNotNull())
        done = closed if done is None else done.unionByName(closed)
        if depth == BITS or leaves.where("depth IS NULL").isEmpty():
            break
        open_rows = stage(placed.where(F.col("depth").isNull()).drop("depth"))
        kept.append(open_rows)
        top, depth = depth + 1, min(BITS, depth + bits_a_round)
    named = done.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.expr(f"substr(lpad(bin(h), {BITS}, '0'), 1, depth)")))
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("total"), F.count("*").alias("n"))
    over = stage(sizes.where((F.col("total") > limit) & (F.col("n") > 1)).select("shard"))  # buckets of equal rows
    salt = Window.partitionBy("h", "salt").orderBy("doc_id")
    dealt = (
        named.join(over, "shard", "left_semi")
        .withColumn("nth", F.row_number().over(salt) - 1)
        .withColumn("part", F.concat_ws("-", "salt", F.floor(F.col("nth") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))))))
    )
    plain = named.join(over, "shard", "left_anti").withColumn("part", F.lit("0"))
    cols = ["doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard", "part"]
    return hand_over(plain.select(*cols).unionByName(dealt.select(*cols)), *kept, over)


#: Byte limit of the registered query.
LIMIT = 1 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), LIMIT)


ORACLE_OP2 = f"""
WITH k AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT d, h >> ({BITS} - d) AS p, sum(n_bytes) AS total, min(h) AS lo, max(h) AS hi
  FROM k, (SELECT unnest(range(0, {BITS} + 1)) AS d) GROUP BY ALL),
leaf AS (
  SELECT k.doc_id, k.h, k.n_bytes, min(s.d) AS depth
  FROM k JOIN s ON s.p = k.h >> ({BITS} - s.d) WHERE s.total <= {LIMIT} OR s.lo = s.hi GROUP BY ALL)
SELECT doc_id, n_bytes, depth::INT AS depth, substr(lpad(bin(h), {BITS}, '0'), 1, depth::INT) AS shard, '0' AS part FROM leaf
"""
