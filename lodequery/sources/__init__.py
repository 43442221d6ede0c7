"""Table loading."""
from lodequery.sources.tables import append_row, insert_once, inserted, load_table, write_table

__all__ = ["append_row", "insert_once", "inserted", "load_table", "write_table"]
