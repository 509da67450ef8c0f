"""Sources (raw CSV/parquet, driver-table fixtures) and sinks."""

from routewise.sources.fixtures import fixture_tables
from routewise.sources.raw import MissingInputError, load_raw_tables, read_prepared, table_profile
from routewise.sources.sinks import write_prepared, write_results, write_table

__all__ = ["fixture_tables", "load_raw_tables", "read_prepared", "table_profile", "MissingInputError",
           "write_prepared", "write_results", "write_table"]
