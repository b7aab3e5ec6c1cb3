"""Outputs beside Parquet tables."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in as many files as the frame has partitions."""
    df.write.mode("overwrite").json(path)


def json_document(path: str, **parts: DataFrame | str | int | float | None) -> None:
    """One JSON document of named small frames and values, with sorted keys; it appears whole or not at all.

    For reports of bounded size: the frames come to the driver."""
    body = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    target = Path(path)
    fresh = target.with_name(f".{target.name}.{os.getpid()}")
    fresh.write_text(json.dumps(body, sort_keys=True, ensure_ascii=False, default=str, indent=1), encoding="utf-8")
    os.replace(fresh, target)


def overwrite_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that df has rows for and leave all others, so a repeated write changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
