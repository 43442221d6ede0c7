"""Column functions."""
from lodequery.functions.text import json_fields, make_id, normalize_space, now_id, or_false, parse_iso_date, records_found_text

__all__ = ["json_fields", "make_id", "normalize_space", "now_id", "or_false", "parse_iso_date", "records_found_text"]
