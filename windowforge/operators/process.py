"""A hook for work that is given from outside, a row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def process_rows(rows: DataFrame, process_one: Callable[[dict], dict], schema: str) -> DataFrame:
    """``process_one(row)`` for every row, in the tasks that hold them: the columns of ``schema``, and error.

    A row whose processing fails, or gives a value that doesn't fit, has nulls and the error's name and message; the others go on. Columns that the result lacks
    are null, others of it are left out.
    """
    fields = _parse_datatype_string(schema)
    out = StructType(list(fields.fields)).add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for b in batches:
            done = []
            for row in b.to_pylist():
                try:
                    result = process_one(row)
                    got = {k.name: pa.scalar(result.get(k.name), k.type).as_py() for k in kinds if k.name != "error"}
                    done.append(got | {"error": None})
                except Exception as e:  # the hook's own errors are its rows' results
                    done.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return rows.mapInArrow(run, out)
