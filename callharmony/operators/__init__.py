from callharmony.operators.audit import (
    audit_summary,
    call_metrics,
    page_audit,
    page_counts,
    record_count,
    with_running_total,
)
from callharmony.operators.crosswalk import load_crosswalk, map_call_type
from callharmony.operators.project import conform, fill_missing, label, map_fields
from callharmony.operators.ranges import apply_range
from callharmony.operators.upsert import delete_matching, empty_like, fold_pages, upsert

__all__ = [
    "apply_range", "audit_summary", "call_metrics", "conform", "delete_matching", "empty_like",
    "fill_missing", "fold_pages", "label", "load_crosswalk", "map_call_type", "map_fields",
    "page_audit", "page_counts", "record_count", "upsert", "with_running_total",
]
