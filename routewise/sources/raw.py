"""Readers for the nine raw marketplace tables (CSV or parquet)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from routewise.schemas import RAW_COLUMNS, RAW_FILES, Tables


class MissingInputError(FileNotFoundError):
    """An input table is absent or lacks a required column."""


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Select the needed columns by name and cast them (ANSI: a malformed
    value raises instead of becoming NULL)."""
    missing = [c for c, _ in RAW_COLUMNS[table] if c not in df.columns]
    if missing:
        raise MissingInputError(f"{table}: missing column(s) {missing}")
    cols = []
    for name, typ in RAW_COLUMNS[table]:
        c = F.col(name)
        if typ == "double":
            # NaN is not NULL in Spark: normalise so averages skip it.
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        else:
            c = c.cast(typ)
        cols.append(c.alias(name))
    return df.select(*cols)


#: Tables with free-text columns.
MULTILINE_TABLES = frozenset({"reviews"})


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Header CSV; every column read as text (no inference pass), then
    projected and cast by name. Only tables with free text can hold line
    breaks inside quotes; the others are split into many tasks."""
    try:
        raw = (spark.read.option("header", True).option("multiLine", table in MULTILINE_TABLES)
               .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
               .csv(path))
        return _typed(raw, table)
    except AnalysisException as exc:  # PATH_NOT_FOUND and friends
        raise MissingInputError(f"{table}: cannot read {path}: {exc}") from exc


def read_parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    try:
        return _typed(spark.read.parquet(path), table)
    except AnalysisException as exc:
        raise MissingInputError(f"{table}: cannot read {path}: {exc}") from exc


def load_raw_tables(spark: SparkSession, data_dir: str, fmt: str = "csv",
                    files: dict[str, str] | None = None) -> Tables:
    """Load all nine tables lazily; a missing input fails fast with its name."""
    files = files or RAW_FILES
    out = {}
    for table, fname in files.items():
        if fmt == "csv":
            path = os.path.join(data_dir, fname)
            out[table] = read_csv_table(spark, path, table)
        else:
            stem = os.path.splitext(fname)[0]
            out[table] = read_parquet_table(spark, os.path.join(data_dir, stem), table)
    return Tables(**out)


def table_profile(tables: Tables) -> DataFrame:
    """Rows and column count per table as one DataFrame (one count job per
    table is planned as a single union of global aggregates)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows",
                F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
        for name, df in tables.as_dict().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Column types of the prepared (master / train / test) tables; the
# ``cat_<name>`` dummies are data-dependent and typed by their prefix.
PREPARED_TYPES: dict[str, str] = {
    **{c: "timestamp_ntz" for c in [
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date"]},
    **{c: "double" for c in [
        "total_price", "total_freight", "total_order_value", "freight_ratio", "product_weight_g",
        "cust_lat", "cust_lng", "sell_lat", "sell_lng", "distance_km", "actual_delivery_days",
        "estimated_delivery_days", "delivery_delay_days", "carrier_handling_days"]},
    **{c: "int" for c in [
        "is_late", "same_state", "pay_credit_card", "pay_boleto", "pay_debit_card",
        "purchase_month", "purchase_dow", "purchase_hour", "satisfied"]},
    **{c: "bigint" for c in ["num_items", "payment_installments", "review_score"]},
}


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet",
                  id_type: str = "string") -> DataFrame:
    """Typed re-read of a prepared table. Parquet keeps its types; CSV is
    read as text (no inference pass) and cast by column name (ids and
    zip prefixes to ``id_type`` / bigint, ``cat_*`` dummies to int)."""
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        raw = (spark.read.option("header", True).option("multiLine", True)
               .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))
    except AnalysisException as exc:
        raise MissingInputError(f"cannot read prepared table {path}: {exc}") from exc

    def typ(c: str) -> str:
        if c in PREPARED_TYPES:
            return PREPARED_TYPES[c]
        if c.startswith("cat_"):
            return "int"
        if c.endswith("_zip_code_prefix"):
            return "bigint"
        if c.endswith("_id"):
            return id_type
        return "string"
    return raw.select(*[F.col(c).cast(typ(c)).alias(c) for c in raw.columns])
