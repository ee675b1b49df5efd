"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answers, asking, indexes, knowledge, metrics, operations, writing
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
MODULES = (knowledge, writing, operations, answers, metrics, indexes, asking)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["facts_current"](spark, sf_dir)
