"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import queries_eval, queries_formulas, queries_lake, queries_minute, queries_portfolio, queries_research

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (queries_lake, queries_formulas, queries_eval, queries_minute, queries_portfolio, queries_research):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
