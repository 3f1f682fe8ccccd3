from callharmony.sinks.jdbc import staging_sql, upsert_sql, write_jdbc
from callharmony.sinks.preview import preview
from callharmony.sinks.raw import land_raw, land_raw_text
from callharmony.sinks.table import CallTable

__all__ = [
    "CallTable", "land_raw", "land_raw_text", "preview", "staging_sql", "upsert_sql", "write_jdbc",
]
