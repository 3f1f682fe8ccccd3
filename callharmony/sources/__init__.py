from callharmony.sources.arrays import read_array_files
from callharmony.sources.catalog import recover_runs, register_raw, register_raw_runs
from callharmony.sources.envelopes import (
    DATASTORE,
    FEATURES,
    ROW_ARRAY,
    Envelope,
    observed_fields,
    page_sizes,
    parse_body,
    parse_rows,
    raw_rows,
    unwrap,
)
from callharmony.sources.landed import (
    land_pages,
    read_datastore_pages,
    read_feature_pages,
    read_page_files,
    read_page_table,
    read_row_array,
    read_row_lines,
    replace_run,
    stream_page_files,
)
from callharmony.sources.specs import SPECS, SourceSpec, TimeRange, TimeRule

__all__ = [
    "DATASTORE", "FEATURES", "ROW_ARRAY", "Envelope", "SPECS", "SourceSpec", "TimeRange", "TimeRule",
    "land_pages", "observed_fields", "page_sizes", "parse_body", "parse_rows", "raw_rows",
    "read_array_files", "read_datastore_pages", "read_feature_pages", "read_page_files", "read_page_table",
    "read_row_array", "read_row_lines", "recover_runs", "register_raw", "register_raw_runs", "replace_run", "stream_page_files", "unwrap",
]
