"""The sources, declared: where rows come from and which canonical field each source field feeds."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, functions as F

from callharmony.functions import (
    epoch_ms_to_ts,
    join_date_time,
    text_to_ts,
    wall_to_utc,
    whole_number,
)
from callharmony.sources.envelopes import DATASTORE, FEATURES, ROW_ARRAY, Envelope


@dataclass(frozen=True)
class TimeRule:
    """How a source writes its call time: the columns, and a zone if it is a local wall time."""

    columns: tuple[str, ...]
    tz: str | None = None
    epoch_ms: bool = False

    def source_time(self) -> Column:
        """The time as the source means it, before any zone shift; range bounds compare to this."""
        if self.epoch_ms:
            return epoch_ms_to_ts(whole_number(F.col(self.columns[0])))
        return text_to_ts(self._text())

    def call_time(self, source_time: Column) -> Column:
        return wall_to_utc(source_time, self.tz) if self.tz else source_time

    def rejected(self, source_time: Column) -> Column:
        """A time was sent but could not be read."""
        return self._text().isNotNull() & source_time.isNull()

    def _text(self) -> Column:
        columns = [F.col(name) for name in self.columns]
        return join_date_time(*columns) if len(columns) == 2 else columns[0]


@dataclass(frozen=True)
class TimeRange:
    """Closed bounds on the source's time, as the source is asked for them."""

    low: date | datetime
    high: date | datetime
    half_open: bool = False


@dataclass(frozen=True, eq=False)
class SourceSpec:
    slug: str
    label: str
    envelope: Envelope
    time: TimeRule
    texts: dict[str, str]
    flags: dict[str, str] = field(default_factory=dict)
    time_range: TimeRange | None = None
    has_crosswalk: bool = True
    page_size: int | None = None
    url: str = ""
    resource: str = ""
    where: str = ""
    order: str = ""
    key: str = ""  # a whole number that orders the rows, where there is one
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def paged(self) -> bool:
        """Fetched and upserted page by page, or in one reply that is a single batch."""
        return self.envelope.name != ROW_ARRAY.name

    @property
    def fields(self) -> list[str]:
        """Every source field the canonical row needs."""
        return list(dict.fromkeys([*self.time.columns, *self.texts.values(), *self.flags.values()]))


# Flag fields, canonical name to source name.
RELATED_FLAGS = {
    "alcohol": "alcohol_related",
    "domestic_violence": "dv_related",
    "drug": "drug_related",
}

# Labels, endpoints, page sizes, bounds, zones and field names of the sources.
PHOENIX = SourceSpec(
    slug="arizona-phoenix",
    label="Phoenix, AZ",
    envelope=DATASTORE,
    time=TimeRule(("CALL_RECEIVED",), tz="America/Phoenix"),
    texts={
        "call_id": "INCIDENT_NUM",
        "call_type": "FINAL_CALL_TYPE",
        "disposition": "DISPOSITION",
        "priority": "priority",
    },
    flags=RELATED_FLAGS,
    time_range=TimeRange(date(2020, 12, 31), date(2022, 1, 1)),
    url="https://www.phoenixopendata.com/api/3/action/datastore_search_sql",
    resource="1d536ee6-7ffb-49c3-bffe-5cdd98a3c97e",
    order='"_id" ASC',
    key="_id",
)

GAINESVILLE = SourceSpec(
    slug="florida-gainesville",
    label="Gainesville, FL",
    envelope=ROW_ARRAY,
    time=TimeRule(("report_date",), tz="America/New_York"),
    texts={"call_id": "id", "call_type": "narrative", "priority": "priority"},
    flags=RELATED_FLAGS,
    time_range=TimeRange(datetime(2021, 1, 1), datetime(2021, 12, 31, 11, 59, 59)),
    page_size=5_000_000,
    url="https://data.cityofgainesville.org/resource/gvua-xt9q.json",
    order=":id",
)

NEW_ORLEANS = SourceSpec(
    slug="louisiana-new-orleans",
    label="New Orleans, LA",
    envelope=ROW_ARRAY,
    time=TimeRule(("timecreate",), tz="America/Chicago"),
    texts={
        "call_id": "nopd_item",
        "call_type": "initialtypetext",
        "disposition": "dispositiontext",
        "priority": "priority",
    },
    flags=RELATED_FLAGS,
    page_size=5_000_000,
    url="https://data.nola.gov/resource/3pha-hum9.json",
    order=":id",
)

BALTIMORE = SourceSpec(
    slug="maryland-baltimore",
    label="Baltimore, MD",
    envelope=FEATURES,
    time=TimeRule(("calldatetime",), epoch_ms=True),
    texts={"call_id": "callnumber", "call_type": "description", "priority": "priority"},
    time_range=TimeRange(date(2021, 1, 1), date(2021, 12, 31)),
    has_crosswalk=False,
    page_size=2000,
    url=(
        "https://opendata.baltimorecity.gov/egis/rest/services/NonSpatialTables/"
        "CallsForService_2021_Present/FeatureServer/0/query"
    ),
    aliases={"calldatetime": ("callDateTime",), "callnumber": ("callNumber",)},
)

WORCESTER = SourceSpec(
    slug="massachusetts-worcester",
    label="Worcester, MA",
    envelope=FEATURES,
    time=TimeRule(("Date_Logged", "Time_Logged"), tz="America/New_York"),
    texts={"call_id": "Incident_Number", "call_type": "Incident_Type"},
    page_size=1000,
    url=(
        "https://services1.arcgis.com/j8dqo2DJE7mVUBU1/arcgis/rest/services/"
        "Police_Incident_Data_-_2021/FeatureServer/0/query"
    ),
)

BURLINGTON = SourceSpec(
    slug="vermont-burlington",
    label="Burlington, VT",
    envelope=FEATURES,
    time=TimeRule(("call_time",)),
    texts={"call_id": "incident_number", "call_type": "call_type", "priority": "priority"},
    flags={**RELATED_FLAGS, "mental_health": "mental_health"},
    page_size=1000,
    url=(
        "https://maps.burlingtonvt.gov/arcgis/rest/services/Hosted/"
        "Police_Incidents_2021/FeatureServer/0/query"
    ),
)

SPECS: dict[str, SourceSpec] = {
    spec.slug: spec for spec in (PHOENIX, GAINESVILLE, NEW_ORLEANS, BALTIMORE, WORCESTER, BURLINGTON)
}
