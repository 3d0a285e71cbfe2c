"""The registered queries over the driver's tables and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import findings, more, people, pictures, records, sales_reports, search, sheets

MODULES = [sales_reports, findings, people, search, more, records, pictures, sheets]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = "graded_master"
