"""Readers and writers."""

from .readers import TableError, blank_to_null, load_csv, load_table, validate_table
from .writers import escape_formulas, write_audit, write_clean

__all__ = [
    "TableError",
    "blank_to_null",
    "escape_formulas",
    "load_csv",
    "load_table",
    "validate_table",
    "write_audit",
    "write_clean",
]
