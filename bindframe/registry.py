"""All queries of the binding-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindframe.plans import features, intervals, labels, models, mutation, picks, probes, replicates, rows, selection, sites, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (intervals, sites, replicates, tables, rows, selection, mutation, models, labels, probes, features, picks):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
