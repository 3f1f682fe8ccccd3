import json
from dataclasses import replace

import pytest
from bodies import features, pages

from callharmony import session
from callharmony.__main__ import main, parse_args
from callharmony.operators import load_crosswalk
from callharmony.plans import fetch_pages, run, run_to_warehouse
from callharmony.session import shuffle_conf
from callharmony.sinks import CallTable
from callharmony.sources import SPECS, land_pages

BTV = SPECS["vermont-burlington"]


def call(i, kind):
    return {"incident_number": i, "call_time": "2021-07-01 10:00:00", "call_type": kind}


def test_run_audit_and_show(spark, tmp_path, capsys):
    landed, table = str(tmp_path / "pages"), str(tmp_path / "calls")
    land_pages(pages(spark, features(call("1", "Noise"), call("2", "DUI")), dataset=BTV.slug), landed)
    main(["run", BTV.slug, "--pages", landed, "--table", table, "--lake", str(tmp_path), "--run-id", "r1"])
    assert "2 records found." in capsys.readouterr().out
    main(["audit", BTV.slug, "--pages", landed])
    assert "|vermont-burlington|r1    |1    |2      |true" in capsys.readouterr().out
    main(["show", "--table", table])
    shown = capsys.readouterr().out
    assert "common_call_type: string" in shown and "NEGLECT" in shown and "-RECORD 1" in shown
    assert (tmp_path / "data" / BTV.slug / "run_id=r1").is_dir()


def test_stream_from_the_command_line(spark, tmp_path):
    landing = tmp_path / "run_id=r1"
    landing.mkdir()
    (landing / "page-0.json").write_text(features(call("1", "Noise")))
    args = ["--pages", str(landing), "--table", str(tmp_path / "calls"), "--checkpoint", str(tmp_path / "check")]
    main(["stream", BTV.slug, *args])
    assert [r.call_id for r in CallTable(spark, str(tmp_path / "calls")).read().collect()] == ["1"]


@pytest.mark.parametrize("argv", [["run", BTV.slug, "--table", "t"], ["audit"], ["show"], ["run", "elsewhere"]])
def test_bad_arguments(argv, capsys):
    with pytest.raises(SystemExit):
        parse_args(argv)


def test_fetch_land_and_run(spark, tmp_path):
    """From requests to the table, with a function in place of the service."""
    log = str(tmp_path / "requests")

    def fetch(request):
        with open(log, "a") as file:
            file.write(json.dumps(request.params) + "\n")
        if "returnCountOnly" in request.params:
            return '{"count": 25}'
        numbers = range(25)[request.offset : request.offset + int(request.params["resultRecordCount"])]
        rows = [{"incident_number": i, "call_time": "2021-07-01 10:00:00", "call_type": "DUI"} for i in numbers]
        return json.dumps({"features": [{"attributes": row} for row in rows]})

    small = replace(BTV, page_size=10)
    fetch_pages(spark, small, str(tmp_path / "pages"), "r1", fetch, pages_per_task=1)
    landed = fetch_pages(spark, small, str(tmp_path / "pages"), "r1", fetch, pages_per_task=1)
    calls = CallTable(spark, str(tmp_path / "calls"))
    report = run(small, landed, load_crosswalk(spark), calls, str(tmp_path / "lake"), "r1")
    assert report.records == 25 and calls.read().count() == 25
    asked = [json.loads(line) for line in open(log)]
    assert sorted(int(a["resultOffset"]) for a in asked if "returnCountOnly" not in a) == [0, 0, 10, 10, 20, 20]
    assert not (tmp_path / "pages-fetching" / BTV.slug / "r1").exists()


def test_warehouse_job_prepares_staging_first(spark):
    ran = []
    df = pages(spark, features(call("1", "Noise")), dataset=BTV.slug)
    with pytest.raises(Exception, match="(?i)driver"):
        run_to_warehouse(BTV, df, load_crosswalk(spark), "jdbc:nowhere:x", "public.call_data", "public.r1", ran.append)
    assert ran == ["DROP TABLE IF EXISTS public.r1", "CREATE TABLE public.r1 AS SELECT * FROM public.call_data LIMIT 0"]


def test_shuffle_partitions_follow_the_input():
    assert shuffle_conf(10**9)["spark.sql.shuffle.partitions"] == "200"
    assert shuffle_conf(100 * 10**12)["spark.sql.shuffle.partitions"] == str(100 * 10**12 // 2**29)


def test_input_size_sets_the_partitions(spark, tmp_path, monkeypatch, conf):
    conf(spark__sql__shuffle__partitions="4", spark__sql__files__maxPartitionBytes="128MB",
         spark__sql__adaptive__advisoryPartitionSizeInBytes="64MB")
    (tmp_path / "f").write_text("12345")
    assert session.input_bytes(spark, str(tmp_path)) == 5
    session.fit_to(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    monkeypatch.setattr(session, "input_bytes", lambda *_: 10**12)
    session.fit_to(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(10**12 // 2**29)
