"""Each source's job on a fixture that holds the awkward cases of its data."""

import json
from dataclasses import replace
from datetime import datetime

import pytest
from bodies import ERROR, datastore, features, pages, row_array

from callharmony.operators import audit_summary, load_crosswalk
from callharmony.plans import IncompleteFetch, harmonize, run, run_all
from callharmony.plans.jobs import audit
from callharmony.schema import CALL_SCHEMA
from callharmony.sinks import CallTable
from callharmony.sources import SPECS

PHX, GNV, NOLA, BAL, WOR, BTV = (
    SPECS[s]
    for s in (
        "arizona-phoenix", "florida-gainesville", "louisiana-new-orleans",
        "maryland-baltimore", "massachusetts-worcester", "vermont-burlington",
    )
)


@pytest.fixture(scope="module")
def crosswalk(spark):
    return load_crosswalk(spark)


def millis(*args):
    return int((datetime(*args) - datetime(1970, 1, 1)).total_seconds() * 1000)


def phoenix(spark):
    def call(i, num, time, kind, **more):
        return {"_id": i, "INCIDENT_NUM": num, "CALL_RECEIVED": time, "FINAL_CALL_TYPE": kind,
                "DISPOSITION": "DONE", "priority": 2, **more}

    return pages(
        spark,
        datastore(
            call(1, "p1", "2021-05-01 10:00:00", "FIGHT", alcohol_related=1),
            call(2, "p2", "2021-05-01T23:00:00", "SUSPICIOUS PERSON", dv_related=0, drug_related=2),
            call(3, None, "2021-05-02 00:00:00", "fight"),
            call(4, "p4", "2022-01-01 00:00:00", "TRESPASSING"),
            call(5, "p5", "2022-01-01 00:00:01", "FIGHT"),
            call(6, "p6", "soon", "FIGHT"),
            call(7, "p7", None, "FIGHT"),
            truncated=True,
        ),
        datastore(
            call(8, "p1", "2021-06-01 10:00:00", "OTHER"),
            call(9, "p1", "2021-06-01 10:00:00", "OTHER"),
            call(10, 10, "2020-12-31 00:00:00", None),
            truncated=False,
        ),
        dataset=PHX.slug,
    )


def gainesville(spark):
    def call(i, time, kind, **more):
        return {"id": i, "report_date": time, "narrative": kind, **more}

    return pages(
        spark,
        row_array(
            call("g1", "2021-03-14T02:30:00.000", "Affray", priority="1", alcohol_related="1"),
            call("g2", "2021-11-07T01:30:00.000", "Theft Grand - Value 300 to 4"),
            call("g2", "2021-11-07T01:30:00.000", "Noise Complaint"),
            call("g3", "2021-12-31T11:59:59.000", "NOISE COMPLAINT"),
            call("g4", "2021-12-31T12:00:00.000", "Suicide"),
            call(None, "2021-01-01T00:00:00.000", "Suicide"),
            call("g6", "2021-99-01", "Suicide"),
        ),
        dataset=GNV.slug,
    )


def new_orleans(spark):
    def call(i, time, kind, **more):
        return {"NOPD_Item": i, "timecreate": time, "initialtypetext": kind, "dispositiontext": "NAT", **more}

    return pages(
        spark,
        row_array(
            call("n1", "2021-07-01T10:00:00.000", "SIMPLE ROBBERY, PROPERTY SNATCHING", priority="2A"),
            call("n2", "2019-01-01T10:00:00.000", "SUICIDE", dv_related=1),
            call("n3", "??", "NOISE COMPLAINT"),
            call(None, None, None),
        ),
        dataset=NOLA.slug,
    )


def baltimore(spark):
    def call(i, time, kind="Burglary"):
        return {"callNumber": i, "callDateTime": time, "description": kind, "priority": "High"}

    full = [call(f"b{i}", millis(2021, 5, 1) + i) for i in range(2000)]
    return pages(
        spark,
        features(*full),
        features(
            call("b0", millis(2021, 12, 31)), call("b1", millis(2021, 12, 31) + 1), call("new", millis(2021, 1, 1)),
            call("old", millis(2020, 12, 31)), call(None, millis(2021, 6, 1) + 123), call("none", None),
        ),
        dataset=BAL.slug,
    )


def worcester(spark):
    def call(i, date, time, kind):
        return {"Incident_Number": i, "Date_Logged": date, "Time_Logged": time, "Incident_Type": kind, "priority": 9}

    full = [call(i, "2021-07-01", "10:00:00", "UNK - Unknown Problem") for i in range(1000)]
    last = [call(5, "2021-07-02", "00:00:00", "LAO - Larceny Over $250"), call("w2", None, "10:00", "SUS"),
            call("w3", "2021-07-01", "25:99", "BEC - Commercial B&E")]
    return pages(spark, features(*full), features(*full), features(*last), dataset=WOR.slug)


def burlington(spark):
    def call(i, time, kind, *flags):
        names = ("alcohol_related", "dv_related", "drug_related", "mental_health")
        return {"incident_number": i, "call_time": time, "call_type": kind, "priority": "Priority 1",
                **dict(zip(names, flags))}

    full = [call(f"v{i}", "2021-07-01 10:00:00", "Noise", 0, 1, 2, None) for i in range(1000)]
    return pages(spark, features(*full), features(), dataset=BTV.slug)


SOURCES = {PHX: phoenix, GNV: gainesville, NOLA: new_orleans, BAL: baltimore, WOR: worcester, BTV: burlington}


@pytest.fixture
def job(spark, crosswalk, tmp_path):
    def start(spec):
        calls = CallTable(spark, str(tmp_path / spec.slug))
        report = run(spec, SOURCES[spec](spark), crosswalk, calls, str(tmp_path / "lake"), "r1")
        df = calls.read()
        assert df.columns == CALL_SCHEMA.names
        assert [f.dataType for f in df.schema] == [f.dataType for f in CALL_SCHEMA]
        rows = df.collect()
        assert {r.dataset for r in rows} <= {spec.label}
        assert all(r.emergency_category is None and r.call_category is None and r.unit_type is None for r in rows)
        return report, rows

    return start


def by_id(rows):
    return {r.call_id: r for r in rows}


def test_phoenix(job):
    report, rows = job(PHX)
    calls = by_id(rows)
    assert sorted(str(r.call_id) for r in rows) == ["10", "None", "p1", "p1", "p2", "p4", "p6", "p7"]
    assert calls["p6"].call_time is None and calls["p7"].call_time is None
    assert [r.call_type for r in rows if r.call_id == "p1"] == ["OTHER", "OTHER"]
    assert calls["p1"].call_time == datetime(2021, 6, 1, 17) and calls["p1"].common_call_type is None
    assert calls["p2"].call_time == datetime(2021, 5, 2, 6) and calls["p2"].common_call_type == "PERSUSP"
    assert (calls["p2"].alcohol, calls["p2"].domestic_violence, calls["p2"].drug) == (None, False, True)
    assert calls["p4"].call_time == datetime(2022, 1, 1, 7) and calls["p4"].common_call_type == "TRESPASS"
    assert calls["10"].priority == "2" and calls["10"].disposition == "DONE" and calls["10"].mental_health is None
    assert (report.records, report.null_keys, report.time_rejects, report.out_of_range) == (9, 1, 1, 1)
    assert (report.pages, report.bad_pages) == (2, 0)


def test_gainesville(job):
    report, rows = job(GNV)
    calls = by_id(rows)
    assert sorted(str(r.call_id) for r in rows) == ["None", "g1", "g2", "g2", "g3", "g6"]
    assert calls["g6"].call_time is None
    assert calls["g1"].call_time == datetime(2021, 3, 14, 7, 30) and calls["g1"].alcohol is True
    assert calls["g2"].call_time == datetime(2021, 11, 7, 5, 30)
    assert {r.common_call_type for r in rows if r.call_id == "g2"} == {"999", "NOISE"}
    assert calls["g3"].call_time == datetime(2021, 12, 31, 16, 59, 59) and calls["g3"].common_call_type is None
    assert calls["g1"].disposition is None and calls["g1"].priority == "1"
    assert (report.records, report.null_keys, report.unmapped, report.time_rejects) == (6, 1, 1, 1)


def test_new_orleans(job):
    report, rows = job(NOLA)
    calls = by_id(rows)
    assert len(rows) == 4
    assert calls["n1"].call_time == datetime(2021, 7, 1, 15) and calls["n1"].common_call_type == "ROBBERY"
    assert calls["n2"].call_time == datetime(2019, 1, 1, 16) and calls["n2"].domestic_violence is True
    assert calls["n3"].call_time is None and calls["n3"].common_call_type == "NEGLECT"
    assert calls["n1"].disposition == "NAT" and calls["n1"].priority == "2A"
    assert (report.records, report.null_keys, report.unmapped, report.time_rejects) == (4, 1, 0, 1)


def test_baltimore(job, spark):
    report, rows = job(BAL)
    calls = by_id(rows)
    assert len(rows) == 2000 + 3 and calls["none"].call_time is None
    assert calls["b0"].call_time == datetime(2021, 12, 31)
    assert calls["b1"].call_time == datetime(2021, 5, 1, 0, 0, 0, 1000)
    assert calls["new"].call_time == datetime(2021, 1, 1) and calls[None].call_time.microsecond == 123000
    assert all(r.common_call_type is None and r.alcohol is None for r in rows)
    assert (report.records, report.out_of_range) == (2004, 2)
    assert [(r.records, r.complete) for r in audit_summary(audit(BAL, baltimore(spark))).collect()] == [(2006, True)]


def test_worcester(job, spark):
    report, rows = job(WOR)
    calls = by_id(rows)
    assert len(rows) == 1002
    assert calls["5"].call_time == datetime(2021, 7, 2, 4) and calls["5"].common_call_type == "LARCENY"
    assert calls["6"].call_time == datetime(2021, 7, 1, 14) and calls["6"].priority is None
    assert calls["w2"].call_time is None and calls["w3"].call_time is None
    assert (report.records, report.time_rejects) == (2003, 1)


def test_burlington(job, spark):
    report, rows = job(BTV)
    assert len(rows) == 1000 and {r.call_time for r in rows} == {datetime(2021, 7, 1, 10)}
    assert {(r.alcohol, r.domestic_violence, r.drug, r.mental_health) for r in rows} == {(False, True, True, None)}
    assert {r.common_call_type for r in rows} == {"NEGLECT"} and {r.priority for r in rows} == {"Priority 1"}
    assert all(r.complete for r in audit(BTV, burlington(spark)).collect())


def test_raw_rows_land_whole_below_their_own_source(job, spark, tmp_path):
    job(WOR)
    landed = spark.read.json(str(tmp_path / "lake" / "data" / WOR.slug / "run_id=r1"))
    assert landed.count() == 2003 and set(landed.columns) == {
        "Incident_Number", "Date_Logged", "Time_Logged", "Incident_Type", "priority"}
    job(GNV)
    assert sorted(p.name for p in (tmp_path / "lake" / "data").iterdir()) == [GNV.slug, WOR.slug]
    job(GNV)
    folder = tmp_path / "lake" / "data" / GNV.slug / "run_id=r1"
    lines = [json.loads(x) for f in folder.glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 7 and lines[0]["priority"] == "1"


def test_rerun_changes_nothing_but_null_keys(spark, crosswalk, tmp_path):
    calls = CallTable(spark, str(tmp_path / "calls"))
    for run_id in ("r1", "r2"):
        run(PHX, phoenix(spark), crosswalk, calls)
    rows = calls.read().collect()
    assert sorted(str(r.call_id) for r in rows) == ["10", "None", "None", "p1", "p1", "p2", "p4", "p6", "p7"]


def test_all_sources_in_one_upsert(spark, crosswalk, tmp_path):
    calls = CallTable(spark, str(tmp_path / "calls"))
    report = run_all({spec: make(spark) for spec, make in SOURCES.items()}, crosswalk, calls)
    counts = {r.dataset: r["count"] for r in calls.read().groupBy("dataset").count().collect()}
    assert counts == {PHX.label: 8, GNV.label: 6, NOLA.label: 4, BAL.label: 2003, WOR.label: 1002, BTV.label: 1000}
    assert report.buckets > 6 and report.records == 9 + 6 + 4 + 2004 + 2003 + 1000
    assert report.time_rejects == 1 + 1 + 1 + 0 + 1 + 0


def test_error_pages_and_empty_pages_give_no_rows_but_fail_the_audit(spark, crosswalk):
    df = pages(spark, ERROR, features(), dataset=BTV.slug)
    assert harmonize(BTV, df, crosswalk).count() == 0
    got = [(r.page_seq, r.has_rows, r.complete) for r in audit(BTV, df).orderBy("page_seq").collect()]
    assert got == [(0, False, False), (1, True, True)]


@pytest.mark.parametrize("spec", [BTV, NOLA])
def test_a_run_without_rows(spark, crosswalk, tmp_path, spec):
    calls = CallTable(spark, str(tmp_path / "calls"))
    for df in (pages(spark, dataset=spec.slug), spark.range(0).selectExpr(
        "string(id) dataset", "string(id) run_id", "int(id) page_seq", "string(id) body"
    )):
        report = run(spec, df, crosswalk, calls, str(tmp_path / "lake"), "r1")
        assert (report.records, report.time_rejects, calls.read().count()) == (0, 0, 0)


def test_local_times_need_a_utc_session(spark, crosswalk, conf):
    conf(spark__sql__session__timeZone="America/New_York")
    with pytest.raises(ValueError, match="UTC"):
        harmonize(PHX, phoenix(spark), crosswalk)


def test_harmonize_is_one_pass_without_a_shuffle(spark, crosswalk):
    plan = harmonize(PHX, phoenix(spark), crosswalk)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert "PythonEval" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("bodies", [
    [features({"incident_number": "1"}), ERROR, features()],
    [features({"incident_number": "1"}), ERROR],
    [features(*[{"incident_number": str(i)} for i in range(1000)])],
])
def test_an_incomplete_run_is_refused(spark, crosswalk, tmp_path, bodies):
    calls = CallTable(spark, str(tmp_path / "calls"))
    with pytest.raises(IncompleteFetch):
        run(BTV, pages(spark, *bodies, dataset=BTV.slug), crosswalk, calls, str(tmp_path / "lake"), "r1")
    assert not (tmp_path / "calls").exists() and not (tmp_path / "lake").exists()
    report = run(BTV, pages(spark, *bodies, dataset=BTV.slug), crosswalk, calls, allow_incomplete=True)
    assert report.bad_pages > 0 and calls.read().count() == report.records


def test_a_missing_page_is_refused(spark, crosswalk, tmp_path):
    small = replace(BTV, page_size=1)
    df = pages(spark, *[features({"incident_number": str(i)}) for i in range(3)], features(), dataset=BTV.slug)
    calls = CallTable(spark, str(tmp_path / "calls"))
    assert run(small, df, crosswalk, calls).records == 3
    with pytest.raises(IncompleteFetch):
        run(small, df.where("page_seq <> 1"), crosswalk, calls)


def test_two_runs_of_a_row_array_source_count_once(spark, crosswalk, tmp_path):
    first, second = (row_array({"nopd_item": "1", "initialtypetext": t}, {"nopd_item": k, "initialtypetext": t}) for t, k in (("a", "2"), ("b", "3")))
    df = pages(spark, first, dataset=NOLA.slug, run_id="r1").unionByName(pages(spark, second, dataset=NOLA.slug, run_id="r2"))
    calls = CallTable(spark, str(tmp_path / "calls"))
    run(NOLA, df, crosswalk, calls)
    assert sorted((r.call_id, r.call_type) for r in calls.read().collect()) == [("1", "b"), ("2", "a"), ("3", "b")]


def test_bodies_are_read_once_for_the_audit(spark):
    df = audit(BTV, burlington(spark))
    assert "from_json" not in df._jdf.queryExecution().executedPlan().toString()
