"""Canonical JSON and content hashes of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: dict[str, Column]) -> Column:
    """Sorted keys, no spaces, NULLs kept; values must be strings or integers."""
    fields = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_sha256(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def decimal_string(value: Column, scale: int) -> Column:
    """A number as fixed-scale text, so that no binary float reaches a hash."""
    return value.cast(f"decimal(38,{scale})").cast("string")


def sealed(columns: Sequence[str], recorded: str) -> Column:
    """Whether a row's recorded hash equals the hash of its other columns."""
    return content_sha256({c: F.col(c) for c in columns}) == F.col(recorded)
