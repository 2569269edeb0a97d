"""Sources and sinks: the raw sales table and persisted models."""

from revcurve.sources.files import read_model, read_sales, save_model_table, write_model
from revcurve.sources.testdata import load_sales, sales_from_tables, sales_from_testdata

__all__ = [
    "load_sales",
    "read_model",
    "read_sales",
    "sales_from_tables",
    "sales_from_testdata",
    "save_model_table",
    "write_model",
]
