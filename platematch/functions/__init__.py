"""Helpers shared by the operators: text rules, skew-safe joins, ranking, table difference."""
from platematch.functions.diff import changed_buckets, diff_tables, diff_tables_by_key
from platematch.functions.dominance import dominance_join, size_bins
from platematch.functions.ranking import newest_first_rank
from platematch.functions.search import search_rows, search_texts
from platematch.functions.skew import grid_join, left_lookup
from platematch.functions.text import clean_parameter, contains_like, joined

__all__ = ["changed_buckets", "clean_parameter", "contains_like", "diff_tables", "diff_tables_by_key", "dominance_join",
           "grid_join", "joined", "left_lookup", "newest_first_rank", "search_rows", "search_texts", "size_bins"]
