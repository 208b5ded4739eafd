"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_windows", "q_accounting", "q_samples", "q_decisions", "q_holdout", "q_sources", "q_refusals", "q_files", "q_panel", "q_micro", "q_jobs", "q_models", "q_folds", "q_streams", "q_ordered")


def _load():
    registry = importlib.import_module("tidepanel.catalog.registry")
    for module in MODULES:
        importlib.import_module(f"tidepanel.catalog.{module}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("tidepanel.catalog.q_accounting").flagship(spark, sf_dir)
