"""Call-data harmonization on Spark: many city sources, one table of calls."""

from callharmony.schema import CALL_SCHEMA, KEYS, PAGE_SCHEMA

__all__ = ["CALL_SCHEMA", "KEYS", "PAGE_SCHEMA"]
