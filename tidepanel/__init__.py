"""Spark-first analytics for market-style time-series panels and event streams."""
