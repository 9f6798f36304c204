"""Bounded, repeatable samples of rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(id_col: str) -> Column:
    """A number from 0 to 1 that an id always has."""
    return F.xxhash64(id_col) / F.lit(2.0**64) + 0.5


def sample_ids(rows: DataFrame, id_col: str, most: int, where: Column | None = None) -> DataFrame:
    """The ids of at most ``most`` rows, those with the smallest hash: the same ones at every run.

    Rows are counted first, and only hashes under the share that holds twice as many rows
    are sorted, so no task gets more however many partitions there are.
    """
    ids = rows.where(F.col(id_col).isNotNull()) if where is None else rows.where(where & F.col(id_col).isNotNull())
    ids, n = ids.select(id_col), ids.count()
    if n > 2 * most:
        ids = ids.where(unit_hash(id_col) <= 2 * most / n)
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(most)
