import json
import re
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan

from callharmony.plans import IncompleteFetch, audit, complete_pages, fetch_pages
from callharmony.sources import FEATURES, SPECS, parse_rows
from callharmony.sources.http import page_request, total_rows
from callharmony.sources.paged import FilteredReader, OffsetRange, PagedReader, register_paged

BAL, PHX, GNV = (SPECS[s] for s in ("maryland-baltimore", "arizona-phoenix", "florida-gainesville"))


def service(total, log=None):
    """A feature service of numbered rows that answers offsets, limits and time bounds."""

    def fetch(request):
        if log is not None:
            with open(log, "a") as file:
                file.write(json.dumps(request.params) + "\n")
        rows = [{"callNumber": i, "callDateTime": 1609459200000 + i, "call_time": f"2021-07-01 10:00:{i % 60:02d}", "flag": i % 2 == 0} for i in range(total)]
        for sign, bound in re.findall(r"call_time (>=|<=|>|<) TIMESTAMP '([^']+)'", request.params["where"]):
            keep = {">=": str.__ge__, "<=": str.__le__, ">": str.__gt__, "<": str.__lt__}[sign]
            rows = [r for r in rows if keep(r["call_time"], bound)]
        page = rows[request.offset : request.offset + int(request.params["resultRecordCount"])]
        return json.dumps({"features": [{"attributes": row} for row in page]})

    return fetch


@pytest.mark.parametrize("total", [0, 1, 9, 10, 11, 95])
@pytest.mark.parametrize("stated", [None, 0, 40, 95, 200])
def test_every_row_once_whatever_total_is_stated(total, stated):
    options = {"page_size": "10", "pages_per_task": "3"} | ({} if stated is None else {"total": str(stated)})
    reader = PagedReader(BAL, service(total), None, options, as_rows=False)
    got = [
        row["attributes"]["callNumber"]
        for part in reader.partitions()
        for _, body in reader.read(part)
        for row in json.loads(body)["features"]
    ]
    assert got == list(range(total))


def test_ranges_are_whole_pages_with_an_open_end():
    reader = PagedReader(BAL, service(0), None, {"page_size": "10", "pages_per_task": "3", "total": "95"}, False)
    assert reader.partitions() == [OffsetRange(0, 2), OffsetRange(3, 5), OffsetRange(6, 8), OffsetRange(9, None)]


def test_bodies_through_spark(spark):
    register_paged(spark, BAL, service(95), name="paged_calls")
    df = spark.read.format("paged_calls").options(total=95, page_size=10, pages_per_task=3).load()
    assert df.rdd.getNumPartitions() == 4
    rows = parse_rows(df, FEATURES, ["callnumber"], keep=["page_seq"])
    assert sorted(int(r.callnumber) for r in rows.collect()) == list(range(95))
    assert {r.page_seq for r in rows.collect()} == set(range(10))


BTV = SPECS["vermont-burlington"]


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_rows_as_the_bodies_have_them(spark, conf, pushdown):
    conf(spark__sql__python__filterPushdown__enabled=pushdown)
    register_paged(spark, BTV, service(50), name="paged_rows")
    options = {"page_size": 10, "total": 50, "pages_per_task": 1}
    df = spark.read.format("paged_rows").schema("callnumber STRING, flag STRING").options(**options).load()
    got = df.collect()
    assert sorted(int(r.callnumber) for r in got) == list(range(50)) and {r.flag for r in got} == {"true", "false"}
    assert df.rdd.getNumPartitions() == 5
    assert df.where("callnumber < 7").count() == 7


def pushed(spec, *filters):
    reader = FilteredReader(spec, None, None, {"total": "100", "page_size": "10", "pages_per_task": "1"}, True)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    assert len(reader.partitions()) == 10
    return reader.where


def test_a_datastore_is_read_in_parallel_with_a_page_size():
    spec = replace(PHX, page_size=10)

    def fetch(request):
        limit, offset = (int(x) for x in re.search(r"LIMIT (\d+) OFFSET (\d+)$", request.params["sql"]).groups())
        return json.dumps({"result": {"records": [{"_id": i} for i in range(25)][offset : offset + limit]}})

    reader = PagedReader(spec, fetch, None, {"total": "25", "pages_per_task": "1"}, as_rows=False)
    parts = reader.partitions()
    assert len(parts) == 3
    assert [r["_id"] for p in parts for _, body in reader.read(p) for r in json.loads(body)["result"]["records"]] == list(range(25))


def test_bounds_in_each_dialect():
    low = GreaterThanOrEqual(("call_time",), datetime(2021, 5, 1, 10))
    assert pushed(BTV, low, LessThan(("call_time",), date(2021, 6, 1))) == (
        "call_time >= TIMESTAMP '2021-05-01 10:00:00' AND call_time < DATE '2021-06-01'"
    )
    # Numbers, text and local times are not the services' own: they stay with Spark.
    assert pushed(BTV, GreaterThanOrEqual(("call_time",), "2021-05-01")) == ""
    assert pushed(BAL, GreaterThanOrEqual(("calldatetime",), 1609459200000)) == ""
    assert pushed(PHX, GreaterThanOrEqual(("CALL_RECEIVED",), datetime(2021, 5, 1))) == ""
    utc = replace(PHX, time=replace(PHX.time, tz=None))
    reader = FilteredReader(utc, None, None, {}, True)
    list(reader.pushFilters([GreaterThan(("call_received",), datetime(2021, 5, 1))]))
    assert reader.where == "\"CALL_RECEIVED\" > TIMESTAMP '2021-05-01 00:00:00'"


def test_a_filtered_range_ends_at_its_short_page():
    reader = FilteredReader(BTV, service(50), None, {"total": "50", "page_size": "10", "pages_per_task": "3"}, False)
    list(reader.pushFilters([LessThan(("call_time",), datetime(2021, 7, 1, 10, 0, 12))]))
    read = [len(json.loads(body)["features"]) for part in reader.partitions() for _, body in reader.read(part)]
    assert sum(read) == 12


def test_a_reply_without_rows_ends_the_fetch():
    reader = PagedReader(BTV, lambda request: '{"error": {"code": 400}}', None, {"page_size": "10"}, False)
    with pytest.raises(ValueError, match="without rows"):
        list(reader.read(OffsetRange(0, None)))


def test_a_service_that_says_truncated_is_read_in_turn():
    sizes = [3, 2, 4]

    def fetch(request):
        offset = int(request.params["sql"].rsplit(" ", 1)[1])
        page = {0: 0, 3: 1, 5: 2}[offset]
        records = [{"_id": offset + i} for i in range(sizes[page])]
        return json.dumps({"result": {"records": records, "records_truncated": page < 2}})

    reader = PagedReader(PHX, fetch, None, {"total": "9"}, as_rows=False)
    assert reader.partitions() == [OffsetRange(0, None)]
    assert [seq for seq, _ in reader.read(OffsetRange(0, None))] == [0, 1, 2]


def test_requests_in_each_dialect():
    assert page_request(BAL, 4000).params == {
        "f": "json", "outFields": "*", "resultOffset": "4000", "resultRecordCount": "2000",
        "where": "(callDateTime >= DATE '2021-01-01' AND callDateTime <= DATE '2021-12-31')",
    }
    assert page_request(SPECS["vermont-burlington"], 0).params["where"] == "1=1"
    assert page_request(PHX, 32000).params["sql"] == (
        'SELECT * FROM "1d536ee6-7ffb-49c3-bffe-5cdd98a3c97e" WHERE "CALL_RECEIVED" BETWEEN '
        "DATE '2020-12-31' AND DATE '2022-01-01' ORDER BY \"_id\" ASC OFFSET 32000"
    )
    assert page_request(GNV, 0).params == {
        "$limit": "5000000", "$offset": "0", "$order": ":id",
        "$where": "report_date between '2021-01-01T00:00:00' and '2021-12-31T11:59:59'",
    }
    assert "$where" not in page_request(SPECS["louisiana-new-orleans"], 0).params


def test_total_rows():
    asked = []

    def fetch(request):
        asked.append(request.params)
        return '{"count": 12}'

    assert total_rows(BAL, fetch) == 12 and asked[0]["returnCountOnly"] == "true"

    def stored(request):
        asked.append(request.params)
        return '{"result": {"records": [{"count": "9"}]}}'

    assert total_rows(PHX, stored) == 9 and asked[-1]["sql"].startswith("SELECT count(*)") and "BETWEEN" in asked[-1]["sql"]

    def counted(request):
        asked.append(request.params)
        return '[{"count": "7"}]'

    assert total_rows(GNV, counted) == 7 and asked[-1]["$select"] == "count(*) AS count" and "between" in asked[-1]["$where"]


def capped(rows, cap):
    """A datastore that grants at most ``cap`` rows a reply, and counts 95 whatever it holds."""

    def fetch(request):
        if "count(*)" in request.params["sql"]:
            return '{"result": {"records": [{"count": "95"}]}}'
        limit, offset = (int(x) for x in re.search(r"LIMIT (\d+) OFFSET (\d+)$", request.params["sql"]).groups())
        numbers = range(rows)[offset : offset + min(limit, cap)]
        records = ", ".join(f'{{"_id": {i}, "x": {i}.50, "y": "é\\n"}}' for i in numbers)
        return f'{{"result": {{"records": [{records}], "records_truncated": {json.dumps(cap < limit and offset + cap < rows)}}}}}'

    return fetch


@pytest.mark.parametrize("cap", [1, 3, 9, 10, 40])
@pytest.mark.parametrize("options", [{}, {"total": "95"}, {"total": "40", "pages_per_task": "3"}])
def test_a_datastore_that_caps_below_the_page_size_is_read_whole(cap, options):
    reader = PagedReader(replace(PHX, page_size=10), capped(95, cap), None, options, as_rows=False)
    got = [page for part in reader.partitions() for page in reader.read(part)]
    assert [seq for seq, _ in got] == list(range(10))
    assert [r["_id"] for _, body in got for r in json.loads(body)["result"]["records"]] == list(range(95))
    assert all(f'"x": {seq * 10}.50, "y": "é\\n"' in body for seq, body in got)


def test_more_rows_promised_and_none_sent():
    reader = PagedReader(PHX, lambda request: '{"result": {"records": [], "records_truncated": true}}', None, {"page_size": "10"}, False)
    with pytest.raises(ValueError, match="there are more"):
        list(reader.read(OffsetRange(0, None)))


def test_a_capped_fetch_lands_whole_and_a_short_one_not_at_all(spark, tmp_path):
    spec, landing = replace(PHX, page_size=10, key=""), str(tmp_path / "pages")
    landed = fetch_pages(spark, spec, landing, "r1", capped(95, 4), pages_per_task=2)
    assert complete_pages({spec: landed}) == (24, 0)
    assert audit(spec, landed).agg({"n": "sum"}).first()[0] == 95
    with pytest.raises(IncompleteFetch, match="90 rows were sent, the service counted 95"):
        fetch_pages(spark, spec, landing, "r1", capped(90, 10))
    assert audit(spec, landed).agg({"n": "sum"}).first()[0] == 95
    assert complete_pages({spec: fetch_pages(spark, spec, landing, "r2", capped(90, 10), allow_incomplete=True)}) == (9, 0)


def test_the_count_is_of_the_rows_that_are_asked_for():
    spec = replace(PHX, where="\"X\" = 1")
    asked = []
    total_rows(spec, lambda request: asked.append(request.params["sql"]) or '{"result": {"records": [{"count": "9"}]}}')
    assert asked[0].split(" WHERE ")[1] == page_request(spec, 0).params["sql"].split(" WHERE ")[1].split(" ORDER")[0]
