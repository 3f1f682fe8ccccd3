from collections import Counter
from dataclasses import replace

import pytest
from bodies import ERROR, features

from callharmony.operators import load_crosswalk
from callharmony.plans import IncompleteFetch, run
from callharmony.sinks import CallTable
from callharmony.sources import SPECS, read_page_files
from callharmony.streaming import incremental, run_stream

SPEC = SPECS["vermont-burlington"]


def call(i, kind):
    return {"incident_number": i, "call_time": "2021-07-01 10:00:00", "call_type": kind}


BODIES = [
    features(call("1", "Noise"), call("2", "Noise"), call(None, "Noise")),
    features(call("1", "DUI"), call("3", "DUI"), call("3", "DUI")),
    ERROR,
    features(call("2", "Arson"), call(None, "Arson")),
    features(),
]


def bag(calls):
    return Counter(tuple(r) for r in calls.read().collect())


@pytest.mark.parametrize("files_per_batch", [1, 2, None])
def test_stream_equals_the_batch_job(spark, tmp_path, files_per_batch):
    landing = tmp_path / "landing" / "run_id=r1"
    landing.mkdir(parents=True)
    crosswalk = load_crosswalk(spark)
    streamed = CallTable(spark, str(tmp_path / "streamed"))

    def take_up():
        run_stream(SPEC, str(landing), crosswalk, streamed, str(tmp_path / "checkpoint"), str(tmp_path / "lake"),
                   files_per_batch, allow_incomplete=True)

    # The later pages land first.
    for seq in (3, 4, 1):
        (landing / f"page-{seq}.json").write_text(BODIES[seq])
    take_up()
    for seq in (0, 2):
        (landing / f"page-{seq}.json").write_text(BODIES[seq])
    take_up()
    take_up()

    batch = CallTable(spark, str(tmp_path / "batch"))
    run(SPEC, read_page_files(spark, str(landing), SPEC.slug), crosswalk, batch, allow_incomplete=True)
    assert bag(streamed) == bag(batch) and sum(bag(batch).values()) == 6
    raw = spark.read.json(str(tmp_path / "lake" / "data" / SPEC.slug / "run_id=stream"))
    assert raw.count() == 8


def test_a_lost_page_is_told_and_can_follow(spark, tmp_path):
    landing = tmp_path / "landing" / "run_id=r1"
    landing.mkdir(parents=True)
    table, spec = CallTable(spark, str(tmp_path / "calls")), replace(SPEC, page_size=1)

    def take_up():
        run_stream(spec, str(landing), load_crosswalk(spark), table, str(tmp_path / "checkpoint"))

    take_up()  # nothing has landed
    for seq, body in {0: features(call("1", "DUI")), 2: features()}.items():
        (landing / f"page-{seq}.json").write_text(body)
    for _ in range(2):
        with pytest.raises(IncompleteFetch, match="'r1', 0"):
            take_up()
    (landing / "page-1.json").write_text(features(call("2", "DUI")))
    take_up()
    assert table.read().count() == 2


def test_batches_only_stage_and_are_harmonized_at_once(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing" / "run_id=r1"
    landing.mkdir(parents=True)
    for seq in range(4):
        (landing / f"page-{seq}.json").write_text(features(call("1", f"p{seq}"), call(str(seq), f"p{seq}")))
    (landing / "page-4.json").write_text(features())
    calls, harmonized, plain = CallTable(spark, str(tmp_path / "calls")), [], incremental.harmonize
    monkeypatch.setattr(incremental, "harmonize", lambda *args: harmonized.append(1) or plain(*args))
    run_stream(replace(SPEC, page_size=2), str(landing), load_crosswalk(spark), calls, str(tmp_path / "checkpoint"), files_per_batch=1)
    assert len(harmonized) == 1
    assert {(r.call_id, r.call_type) for r in calls.read().collect()} == {("0", "p0"), ("1", "p3"), ("2", "p2"), ("3", "p3")}
    counts = spark.read.parquet(str(tmp_path / "checkpoint" / "page-counts")).select("batch", "page_seq", "n")
    assert sorted(r.n for r in counts.collect()) == [0, 2, 2, 2, 2] and counts.select("batch").distinct().count() == 5
    assert not (tmp_path / "checkpoint" / "pages").exists() and not (tmp_path / "checkpoint" / "rows").exists()


def test_a_reply_without_rows_stops_its_batch_only(spark, tmp_path):
    landing = tmp_path / "landing" / "run_id=r1"
    landing.mkdir(parents=True)
    table, spec = CallTable(spark, str(tmp_path / "calls")), replace(SPEC, page_size=1)

    def take_up():
        run_stream(spec, str(landing), load_crosswalk(spark), table, str(tmp_path / "checkpoint"))

    (landing / "page-0.json").write_text(features(call("1", "DUI")))
    (landing / "page-1.json").write_text(features())
    take_up()
    (landing / "page-2.json").write_text(features(call("2", "DUI")))
    (landing / "page-3.json").write_text(ERROR)
    for _ in range(2):
        with pytest.raises(Exception, match="1 replies of batch 1 have no rows"):
            take_up()
    assert table.read().count() == 1
