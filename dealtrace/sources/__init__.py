from .rejects import cell_counts, line_counts, read_checked
from .schemas import TABLES, Table, complete, conform, find_column
from .tables import (
    empty_table,
    read_raw,
    read_report,
    read_table,
    read_table_or_empty,
    rows_as_json,
    write_json,
    write_report,
    write_table,
)

__all__ = [
    "TABLES",
    "Table",
    "cell_counts",
    "complete",
    "conform",
    "find_column",
    "line_counts",
    "empty_table",
    "read_checked",
    "read_raw",
    "read_report",
    "read_table",
    "read_table_or_empty",
    "rows_as_json",
    "write_json",
    "write_report",
    "write_table",
]
