from callharmony.functions.casts import cast_to, whole_number
from callharmony.functions.times import (
    epoch_ms_to_ts,
    join_date_time,
    local_to_utc,
    text_to_ts,
    wall_to_utc,
)

__all__ = [
    "cast_to", "epoch_ms_to_ts", "join_date_time", "local_to_utc", "text_to_ts", "wall_to_utc", "whole_number",
]
