"""Writers for prepared tables and result tables.

No ``coalesce(1)``: every partition writes its own file in parallel; a
reader sees the folder as one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_prepared(outputs: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """Master, train, test and the geolocation lookup (one folder each)."""
    for name, df in outputs.items():
        write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt=fmt)


def write_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> None:
    """Small result tables (corridors, tests, model comparison, ...)."""
    for name, df in results.items():
        write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt=fmt)
