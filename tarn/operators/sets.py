"""Set operations by position, with the wider of two column types, and rows compared with nulls as equal."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    both = a.union(b.toDF(*a.columns))
    return both if keep_all else both.distinct()


def intersect(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    b = b.toDF(*a.columns)
    return a.intersectAll(b) if keep_all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    b = b.toDF(*a.columns)
    return a.exceptAll(b) if keep_all else a.subtract(b)
