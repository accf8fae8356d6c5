"""All plans of the match analytics and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bulletins, decisions, entities, evaluation, evidence, feeds, form, learning, names, policy, prediction, rating, readers, reports, results, slates, splits, tickets, validation, versions, walk, watch  # noqa: F401  they register their plans
from .core import PLANS, SQL, Plan


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS["e04_recent_form"](spark, sf_dir)


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
