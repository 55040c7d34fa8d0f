"""Violations as tables, and the one place where they become an error."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ViolationError(ValueError):
    pass


def require_none(violations: DataFrame, message: str, examples: int = 10) -> None:
    """Raise with the first few rows (a bounded number) if there are any."""
    rows = violations.limit(examples).collect()
    if rows:
        raise ViolationError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def head_examples(df: DataFrame, k: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(k)
