"""Tables that are published in two steps: data first, then one small file that makes them the current version.

A version is a file below ``_versions`` that holds the table's schema and the names of the folders which make it up; the highest number counts. Data of a job that fails is never named, so
readers go on with the version before. A version is only added to the one that it was made from: of two writers, the second gets a ``Conflict``. Folders are never
changed, so a table that was read stays as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another version was published in the meantime."""


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> int:
    """The number of the current version; 0 if nothing was published."""
    at, store = _place(spark, f"{path}/_versions")
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return max([0, *(int(n) for n in names if n.isdigit())])


def _lines(spark: SparkSession, path: str, version: int) -> list[str]:
    return [r.value for r in spark.read.text(f"{path}/_versions/{version:08d}", wholetext=True).collect()][0].split("\n")


def folders(spark: SparkSession, path: str, version: int) -> list[str]:
    """Names of the folders that make up a version."""
    return _lines(spark, path, version)[1:-1] if version else []


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the current one by default."""
    version = current(spark, path) if version is None else version
    if not version:
        raise FileNotFoundError(f"nothing was published at {path}")
    schema, *parts = _lines(spark, path, version)[:-1]
    schema = StructType.fromJson(json.loads(schema))
    return read_parts(spark, path, parts, schema)


def read_parts(spark: SparkSession, path: str, parts: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{p}" for p in parts]).drop("_part")


def write_part(df: DataFrame, path: str, *partition_by: str) -> str:
    """First step: ``df`` in a folder of its own, which no version names yet."""
    name = f"_part={uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}") if partition_by else df.write.parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, base: int, parts: list[str], schema: StructType) -> int:
    """Second step: these folders, whose rows have this schema, become the version after ``base``; a ``Conflict`` if there is one already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, store = _place(spark, f"{path}/_versions/{base + 1:08d}")
    draft, _ = _place(spark, f"{path}/_versions/.draft-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write("".join(f"{line}\n" for line in [schema.json(), *parts]).encode())
    out.close()
    try:  # a rename that doesn't replace what is there
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
        files.rename(draft, final, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        store.delete(draft, False)
        if store.exists(final):
            raise Conflict(f"version {base + 1} of {path} was published by another writer") from e
        raise
    return base + 1


def publish(df: DataFrame, path: str, base: int | None = None, *partition_by: str) -> int:
    """``df`` becomes the table's next version, made from ``base`` (the current one by default)."""
    base = current(df.sparkSession, path) if base is None else base
    return commit(df.sparkSession, path, base, [write_part(df, path, *partition_by)], df.schema)
