"""A planned fetch, by offsets and by the order key, with services that fail."""

import json
import re
import sys
from collections import Counter
from dataclasses import replace

import pytest
from pyspark import cloudpickle

from callharmony.operators import load_crosswalk
from callharmony.plans import IncompleteFetch, fetch_pages, run
from callharmony.plans.jobs import audit
from callharmony.sinks import CallTable
from callharmony.sources import SPECS, fetching
from callharmony.sources.fetching import Patience, Range, key_ranges, offset_ranges
from callharmony.sources.http import key_request

# Executors have no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BTV, PHX, NOLA = (SPECS[slug] for slug in ("vermont-burlington", "arizona-phoenix", "louisiana-new-orleans"))
QUICK = Patience(tries=1, pause=0)


def asked(log):
    return [line.rstrip("\n") for line in open(log)] if log.exists() else []


def by_offset(log, total=95, fails=()):
    """Offsets in ``fails`` fail the first time they are asked for."""

    def fetch(request):
        if "returnCountOnly" in request.params:
            return json.dumps({"count": total})
        before = open(log).read().split() if log.exists() else []
        with open(log, "a") as file:
            file.write(f"{request.offset}\n")
        if request.offset in fails and str(request.offset) not in before:
            raise OSError(f"lost at {request.offset}")
        rows = [{"incident_number": str(i), "call_type": "DUI"} for i in range(total)][request.offset : request.offset + request.limit]
        return json.dumps({"features": [{"attributes": row} for row in rows]})

    return fetch


def ids(pages, field="incident_number"):
    return [value for row in pages.orderBy("page_seq").collect() for value in re.findall(rf'"{field}": "?(\w+)', row["body"])]


def test_each_page_lands_once_though_two_requests_fail(spark, tmp_path):
    log, small = tmp_path / "log", replace(BTV, page_size=10)
    pages = fetch_pages(spark, small, str(tmp_path / "pages"), "r1", by_offset(log, fails=(30, 70)), pages_per_task=3, patience=QUICK)
    assert ids(pages) == [str(i) for i in range(95)]
    assert [row["page_seq"] for row in pages.orderBy("page_seq").collect()] == list(range(10))
    assert Counter(asked(log)) == {str(i): 2 if i in (30, 70) else 1 for i in range(0, 95, 10)}
    assert all(row["complete"] for row in audit(small, pages).collect())


def test_a_request_is_tried_again_at_once(spark, tmp_path):
    log = tmp_path / "log"
    fetch_pages(spark, replace(BTV, page_size=10), str(tmp_path / "pages"), "r1", by_offset(log, fails=(30,)), patience=Patience(2, 0))
    assert Counter(asked(log))["30"] == 2 and not (tmp_path / "pages-fetching" / BTV.slug / "r1" / "round=1").exists()


def test_a_broken_call_can_be_repeated(spark, tmp_path):
    log, small, landing = tmp_path / "log", replace(BTV, page_size=10), str(tmp_path / "pages")

    def broken(request):
        if request.offset >= 50:
            raise OSError("down")
        return by_offset(log)(request)

    for _ in range(2):
        with pytest.raises(ConnectionError, match="down"):
            fetch_pages(spark, small, landing, "r1", broken, pages_per_task=2, patience=QUICK)
        assert not (tmp_path / "pages").exists()
    pages = fetch_pages(spark, small, landing, "r1", by_offset(log), pages_per_task=2, patience=QUICK)
    assert ids(pages) == [str(i) for i in range(95)]
    assert Counter(asked(log)) == {str(i): 1 for i in range(0, 95, 10)}


def test_fewer_rows_than_counted_are_refused(spark, tmp_path):
    def short(request):
        return '{"count": 99}' if "returnCountOnly" in request.params else by_offset(tmp_path / "log")(request)

    with pytest.raises(IncompleteFetch, match="95 rows were sent"):
        fetch_pages(spark, replace(BTV, page_size=10), str(tmp_path / "pages"), "r1", short)


def by_key(keys, log, cap=10**9, grows=False):
    """A datastore over the given keys that grants at most ``cap`` rows; with ``grows``, rows are added between pages."""

    def fetch(request):
        sql = request.params["sql"]
        if "count(*)" in sql:
            return json.dumps({"result": {"records": [{"count": str(len(keys))}]}})
        low = int((re.search(r'"_id" > (-?\d+)', sql) or [0, -(10**18)])[1])
        high = int((re.search(r'"_id" <= (-?\d+)', sql) or [0, 10**18])[1])
        limit = int(re.search(r"LIMIT (\d+)", sql)[1])
        assert "OFFSET" not in sql
        now = sorted(keys)
        if grows and limit > 1:
            done = len(asked(log))
            now = sorted([*keys, *(-1 - i for i in range(done))])  # before everything: offsets would shift
        if limit > 1:
            with open(log, "a") as file:
                file.write(f"{low} {high}\n")
        found = [key for key in now if low < key <= high]
        found = (found[::-1] if "DESC" in sql else found)[: min(limit, cap)]
        return json.dumps({"result": {"records": [{"_id": key, "INCIDENT_NUM": f"k{key}", "CALL_RECEIVED": "2021-05-01 10:00:00"} for key in found]}})

    return fetch


@pytest.mark.parametrize("grows", [False, True])
@pytest.mark.parametrize("cap", [10**9, 7])
def test_pages_by_key(spark, monkeypatch, tmp_path, cap, grows):
    monkeypatch.setattr(fetching, "REQUEST_ROWS", 20)
    monkeypatch.setattr("callharmony.plans.jobs.REQUEST_ROWS", 20)
    # Most rows stand close together, so their range has far more pages than planned.
    keys = [*range(1000, 1400), *range(10_000, 200_000, 4_000)]
    log = tmp_path / "log"
    pages = fetch_pages(spark, PHX, str(tmp_path / "pages"), "r1", by_key(keys, log, cap, grows), pages_per_task=2, patience=QUICK)
    assert [int(i) for i in ids(pages, "_id")] == keys
    assert len({line.split()[0] for line in asked(log)}) == len(asked(log))  # no page was asked for twice
    assert all(row["complete"] for row in audit(PHX, pages).collect())
    calls = CallTable(spark, str(tmp_path / "calls"))
    assert run(PHX, pages, load_crosswalk(spark), calls).records == len(keys) == calls.read().count()


def test_ranges():
    assert offset_ranges(95, 10, 3) == [Range(0, 30), Range(30, 60), Range(60, 90), Range(90, None)]
    assert offset_ranges(None, 10, 3) == offset_ranges(0, 10, 3) == [Range(0, None)]
    assert key_ranges(5, 24, 2) == [Range(4, 14), Range(14, None)]
    assert key_ranges(7, 7, 9) == [Range(6, None)]


def test_requests_by_key():
    small = replace(PHX, page_size=5, time_range=None)
    assert key_request(small, 7, 9).params == {"sql": f'SELECT * FROM "{PHX.resource}" WHERE ("_id" > 7 AND "_id" <= 9)'.replace("(", "").replace(")", "") + ' ORDER BY "_id" ASC LIMIT 5'}
    assert key_request(replace(NOLA, page_size=5, key="n"), 7).params == {"$limit": "5", "$order": "n ASC", "$where": "n > 7"}
    assert key_request(replace(BTV, page_size=5, key="oid"), None, last=True).params["orderByFields"] == "oid DESC"


def test_a_source_without_rows(spark, tmp_path):
    pages = fetch_pages(spark, replace(BTV, page_size=10), str(tmp_path / "pages"), "r1", by_offset(tmp_path / "log", total=0))
    assert [row["complete"] for row in audit(BTV, pages).collect()] == [True]


@pytest.mark.parametrize("slug", ["florida-gainesville", "louisiana-new-orleans"])
def test_shipped_specs_are_read_in_many_requests(spark, tmp_path, slug):
    """Sources that are asked for five million rows at once are read in pages of far fewer."""

    most = fetching.REQUEST_ROWS

    def fetch(request):
        if "$select" in request.params:
            return '[{"count": "120000"}]'
        assert request.limit == most
        return json.dumps([{"id": str(i)} for i in range(request.offset, min(request.offset + request.limit, 120_000))])

    pages = fetch_pages(spark, SPECS[slug], str(tmp_path / "pages"), "r1", fetch, pages_per_task=1)
    assert pages.count() == 3 and len(pages.inputFiles()) == 3
    assert all(row["complete"] for row in audit(SPECS[slug], pages).collect())


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """A task and a file for each of thousands of small ranges cost more than the pages in them."""
    written, read = [], fetching.read_ranges

    def spy(spark, spec, parts, *args):
        found = read(spark, spec, parts, *args)
        written.append((len(parts), found.rdd.getNumPartitions()))
        return found

    monkeypatch.setattr(fetching, "read_ranges", spy)
    pages = fetch_pages(spark, replace(BTV, page_size=1), str(tmp_path / "pages"), "r1", by_offset(tmp_path / "log", fails=(30, 70)), pages_per_task=1, patience=QUICK)
    assert ids(pages) == [str(i) for i in range(95)]
    assert Counter(asked(tmp_path / "log")) == {str(i): 2 if i in (30, 70) else 1 for i in range(96)}
    assert written == [(95, fetching.TASKS_A_CORE * spark.sparkContext.defaultParallelism), (2, 2)]


def test_rounds_are_judged_once_each(spark, tmp_path, monkeypatch):
    calls, unfinished = [], fetching.unfinished
    monkeypatch.setattr(fetching, "unfinished", lambda *args: calls.append(1) or unfinished(*args))
    fails = [0, 1, 2]

    def fetch(request):
        if "returnCountOnly" not in request.params and not (tmp_path / f"asked-{request.offset}").exists():
            (tmp_path / f"asked-{request.offset}").touch()
            if request.offset in fails:
                raise OSError("lost")
        return by_offset(tmp_path / "log", total=3)(request)

    pages = fetch_pages(spark, replace(BTV, page_size=1), str(tmp_path / "pages"), "r1", fetch, pages_per_task=3, patience=QUICK)
    assert ids(pages) == ["0", "1", "2"] and len(calls) == 4  # one for each round, not one more in each


def test_tasks_for_ranges():
    assert fetching.task_count(3, 800_000, 4) == fetching.task_count(3, 10, 4) == 3
    assert fetching.task_count(1_000, 800_000, 4) == 1_000
    assert fetching.task_count(18_000, 2_000, 12) == 48 and fetching.task_count(1_000_000, 2_000, 12) == 2_500
