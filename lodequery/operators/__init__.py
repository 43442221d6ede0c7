"""Search criteria, counts, positional selection, tree selection, and joins and frames by time."""
from lodequery.operators.criteria import Search, all_of, any_of, contains, date_range, equals
from lodequery.operators.summary import any_match, nth_by, record_count, single_value
from lodequery.operators.time_joins import as_of_join, interval_join, subtotals, trailing
from lodequery.operators.tree import Page, Selector, has_elements, select_elements, select_many

__all__ = [
    "Page", "Search", "Selector", "all_of", "any_match", "any_of", "as_of_join", "contains", "date_range", "equals", "has_elements",
    "interval_join", "nth_by", "record_count", "select_elements", "select_many", "single_value", "subtotals", "trailing",
]
