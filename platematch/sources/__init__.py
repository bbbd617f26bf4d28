"""Reading, cleaning and writing of domain tables."""
from platematch.sources.domain import (catalog_source, jdbc_source, load_domain, parquet_source, write_bucketed,
                                       write_domain)
from platematch.sources.erp import clean_erp_columns, coerce_for_target, count_rejects, rejected_rows, uncoerced
from platematch.sources.sinks import order_result, shown_hours, worklist_csv_lines, write_analysis, write_worklist_csv

__all__ = [
    "catalog_source", "clean_erp_columns", "coerce_for_target", "count_rejects", "jdbc_source", "load_domain",
    "order_result", "parquet_source", "rejected_rows", "shown_hours", "uncoerced", "worklist_csv_lines", "write_analysis", "write_bucketed",
    "write_domain", "write_worklist_csv",
]
