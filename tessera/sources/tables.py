"""Scans of the driver's parquet tables (S1) with explicit projection.

Every reader selects only the columns the caller names, so the parquet scan's
``ReadSchema`` carries just those columns and filters written afterwards are
pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Parquet scan with projection (only ``columns`` reach the reader)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found in {name}: {missing}; available: {df.columns}")
        df = df.select(*columns)
    return df
