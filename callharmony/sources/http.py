"""Requests to the services, one page each, as the executors send them."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import date, datetime
from urllib.parse import urlencode
from urllib.request import urlopen

from callharmony.sources.envelopes import DATASTORE, FEATURES, ROW_ARRAY
from callharmony.sources.specs import SourceSpec


@dataclass(frozen=True)
class PageRequest:
    url: str
    params: dict[str, str]
    offset: int
    limit: int | None


def literal(spec: SourceSpec, value: date | datetime) -> str:
    """A time in the query dialect of the source's service."""
    if spec.envelope.name == ROW_ARRAY.name:
        return f"'{value.isoformat()}'"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    return f"DATE '{value.isoformat()}'"


def name_in(spec: SourceSpec, column: str) -> str:
    """A column's name as the service has it; the datastore folds names that are not quoted."""
    if spec.envelope.name == DATASTORE.name:
        return '"{}"'.format(column.replace('"', '""'))
    return spec.aliases.get(column, (column,))[0]


def range_condition(spec: SourceSpec) -> str:
    """The source's time range as its service is asked for it."""
    if spec.time_range is None:
        return ""
    name, bounds = name_in(spec, spec.time.columns[0]), spec.time_range
    low, high = literal(spec, bounds.low), literal(spec, bounds.high)
    if bounds.half_open or spec.envelope.name == FEATURES.name:
        return f"({name} >= {low} AND {name} {'<' if bounds.half_open else '<='} {high})"
    between = ("between", "and") if spec.envelope.name == ROW_ARRAY.name else ("BETWEEN", "AND")
    return f"{name} {between[0]} {low} {between[1]} {high}"


def conditions(spec: SourceSpec, where: str = "") -> str:
    """All conditions on a source's rows, as one."""
    found = [c for c in (range_condition(spec), spec.where, where) if c]
    return " AND ".join(f"({c})" for c in found) if len(found) > 1 else "".join(found)


def page_request(spec: SourceSpec, offset: int, where: str = "") -> PageRequest:
    """The request for the page at a row offset, in the dialect of the source's service."""
    condition = conditions(spec, where)
    if spec.envelope.name == FEATURES.name:
        params = {
            "f": "json",
            "outFields": "*",
            "where": condition or "1=1",
            "resultOffset": str(offset),
            "resultRecordCount": str(spec.page_size),
        }
    elif spec.envelope.name == DATASTORE.name:
        sql = [f'SELECT * FROM "{spec.resource}"']
        sql += [f"WHERE {condition}"] if condition else []
        sql += [f"ORDER BY {spec.order}", *([f"LIMIT {spec.page_size}"] if spec.page_size else []), f"OFFSET {offset}"]
        params = {"sql": " ".join(sql)}
    else:
        params = {"$limit": str(spec.page_size), "$offset": str(offset), "$order": spec.order}
        params |= {"$where": condition} if condition else {}
    return PageRequest(spec.url, params, offset, spec.page_size)


def key_request(spec: SourceSpec, after: int | None, upto: int | None = None, last: bool = False) -> PageRequest:
    """The request for the page of rows whose order key comes after ``after``; with ``last``, from the end."""
    name = name_in(spec, spec.key)
    bounds = ([f"{name} > {after}"] if after is not None else []) + ([f"{name} <= {upto}"] if upto is not None else [])
    condition = conditions(spec, " AND ".join(bounds))
    order = f"{name} {'DESC' if last else 'ASC'}"
    if spec.envelope.name == FEATURES.name:
        params = {"f": "json", "outFields": "*", "where": condition or "1=1", "orderByFields": order, "resultRecordCount": str(spec.page_size)}
    elif spec.envelope.name == DATASTORE.name:
        where = f" WHERE {condition}" if condition else ""
        params = {"sql": f'SELECT * FROM "{spec.resource}"{where} ORDER BY {order} LIMIT {spec.page_size}'}
    else:
        params = {"$limit": str(spec.page_size), "$order": order} | ({"$where": condition} if condition else {})
    return PageRequest(spec.url, params, 0, spec.page_size)


def http_fetch(request: PageRequest, timeout: float = 300) -> str:
    with urlopen(f"{request.url}?{urlencode(request.params)}", timeout=timeout) as reply:
        return reply.read().decode("utf-8")


def total_rows(spec: SourceSpec, fetch=http_fetch) -> int | None:
    """How many rows the service holds, if it says so; a plan for parallel reading."""
    request = page_request(spec, 0)
    if spec.envelope.name == FEATURES.name:
        params = {"f": "json", "where": request.params["where"], "returnCountOnly": "true"}
        return json.loads(fetch(replace(request, params=params))).get("count")
    if spec.envelope.name == DATASTORE.name:
        condition = conditions(spec)
        sql = f'SELECT count(*) AS count FROM "{spec.resource}"' + f" WHERE {condition}" * bool(condition)
        rows = (json.loads(fetch(replace(request, params={"sql": sql}))).get("result") or {}).get("records")
    else:
        params = {name: value for name, value in request.params.items() if name == "$where"}
        rows = json.loads(fetch(replace(request, params={"$select": "count(*) AS count", **params})))
    return int(rows[0]["count"]) if isinstance(rows, list) and rows and "count" in rows[0] else None
