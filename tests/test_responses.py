"""Published sets and the full checklist response, batch and stream."""

import pytest
from pyspark.sql import functions as F

from motorlytics.registry.core import AS_OF, latest
from motorlytics.sources import fixtures as FX
from motorlytics.sources import io as IO
from motorlytics.sources.manifest import Manifest
from motorlytics.streaming import responses as RS
from tests.conftest import SF_SMALL

REQUESTS = "request_id long, serial_no string, checklist array<string>"


def frozen(*_):
    return FX.with_feature_scores


@pytest.fixture(scope="module")
def fleet(spark):
    path = IO.write_table(latest(spark, SF_SMALL), IO.shared_path(spark, "test-fleet"))
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def serial(fleet):
    return fleet.agg(F.min("equipment_serial_no")).first()[0]


def published(spark, fleet, root=None):
    sets = Manifest(root or IO.shared_path(spark, "test-sets"))
    sets.publish(spark, {"latest": lambda p: IO.write_table(fleet, p)})
    return sets


def test_lists_of_every_kind(spark, fleet, serial):
    asked = [(1, serial, None), (2, serial, []), (3, serial, ["R2", "R2", "Z9", None]), (4, "nowhere", ["R2"]), (5, None, ["R2"]), (6, serial, ["G4", "S2"]), (6, serial, ["G4", "S2"])]
    seen = {}

    def score(rows):
        seen["rows"] = rows
        return FX.with_feature_scores(rows)

    out = RS.respond(spark.createDataFrame(asked, REQUESTS), fleet, score, AS_OF).collect()
    by = {r["request_id"]: r for r in out}
    assert len(out) == 7 and by[1]["prediction"] == by[2]["prediction"]
    assert by[4]["error"] == "Motor nowhere not found" and by[5]["error"] == "Motor  not found"
    assert all(by[i]["metadata"] is None and by[i]["prediction"] is None and not by[i]["found"] for i in (4, 5))
    assert all(by[i]["error"] is None and by[i]["metadata"]["serial_no"] == serial for i in (1, 2, 3, 6))
    adjusted = {r["request_id"]: r for r in seen["rows"].collect()}
    base = fleet.where(F.col("equipment_serial_no") == serial).first()
    assert adjusted[3]["bearing_failure_count"] == base["bearing_failure_count"] + 2
    assert adjusted[6]["insulation_failure_count"] == base["insulation_failure_count"] + 1
    assert adjusted[6]["repair_count"] == base["repair_count"] + 1 and adjusted[6]["days_since_last_repair"] <= 14


def test_empty_frames(spark, fleet):
    none = spark.createDataFrame([], REQUESTS)
    assert RS.respond(none, RS.asked_motors(none, fleet), FX.with_feature_scores, AS_OF).count() == 0
    one = spark.createDataFrame([(1, "a", ["R2"])], REQUESTS)
    assert RS.respond(one, fleet.limit(0), FX.with_feature_scores, AS_OF).first()["error"] == "Motor a not found"


def test_few_requests_do_not_move_the_fleet(spark, fleet, serial, monkeypatch):
    asked = spark.createDataFrame([(1, serial, ["R2"])], REQUESTS)
    rows = RS.asked_motors(asked, fleet)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(RS, "BROADCAST_BYTES", 1)
    assert RS.asked_motors(asked, fleet) is fleet


def test_replayed_batch_is_written_once(spark, fleet, serial):
    sets, sink = published(spark, fleet), IO.shared_path(spark, "test-answers")
    first = spark.createDataFrame([(1, serial, ["R2"]), (2, serial, [])], REQUESTS)
    second = spark.createDataFrame([(3, serial, ["G4"])], REQUESTS)
    RS.answer_batch(first, 0, sets, frozen, sink, AS_OF)
    RS.answer_batch(second, 1, sets, frozen, sink, AS_OF)
    before = sorted(map(str, spark.read.parquet(sink).collect()))
    RS.answer_batch(second, 1, sets, frozen, sink, AS_OF)
    assert sorted(map(str, spark.read.parquet(sink).collect())) == before and len(before) == 3


def test_restarted_stream_answers_new_files_by_the_new_set(spark, fleet, serial):
    sets = published(spark, fleet)
    source, sink, checkpoint = (IO.shared_path(spark, n) for n in ("test-requests", "test-stream-answers", "test-stream-checkpoint"))

    def run(rows):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(source)
        query = RS.start_response_stream(spark, source, sets, frozen, sink, checkpoint, AS_OF)
        query.awaitTermination()
        return {r["request_id"]: r for r in spark.read.parquet(sink).collect()}

    old = run([(1, serial, ["R2"])])
    published(spark, fleet.withColumn("make", F.lit("other")), sets.root)
    new = run([(2, serial, ["R2"])])
    assert new[1] == old[1] and new[1]["snapshot_version"] == 1
    assert new[2]["snapshot_version"] == 2 and new[2]["metadata"]["manufacturer"] == "other"


def test_a_set_is_in_force_only_as_a_whole(spark, fleet):
    sets = Manifest(IO.shared_path(spark, "test-force"))
    assert sets.current(spark) is None
    small = spark.range(3)

    def dies(path):
        raise OSError("killed")

    with pytest.raises(OSError):
        sets.publish(spark, {"a": lambda p: IO.write_table(small, p), "b": dies})
    assert sets.current(spark) is None
    one = sets.publish(spark, {"a": lambda p: IO.write_table(small, p)})
    with pytest.raises(OSError):
        sets.publish(spark, {"a": lambda p: IO.write_table(spark.range(5), p), "b": dies})
    assert sets.current(spark) == one and spark.read.parquet(one.paths["a"]).count() == 3
    two = sets.publish(spark, {"a": lambda p: IO.write_table(spark.range(5), p)})
    assert sets.current(spark) == two and two.version == 2 and sets.current(spark, 1) == one
    with pytest.raises(RuntimeError):
        RS.answer_batch(spark.createDataFrame([], REQUESTS), 0, Manifest(IO.shared_path(spark, "test-none")), frozen, "unused", AS_OF)


def test_scorer_loads_the_model_of_the_set(spark, fleet, serial):
    from motorlytics.operators import training as TR
    from motorlytics.registry.training import training_sets
    train, _ = training_sets(spark, SF_SMALL)
    model = TR.fit_random_forest(train, {"numTrees": 3, "maxDepth": 3})
    sets = Manifest(IO.shared_path(spark, "test-model-sets"))
    sets.publish(spark, {"latest": lambda p: IO.write_table(fleet, p), "model": lambda p: IO.save_model(model, p)})
    sink = IO.shared_path(spark, "test-model-answers")
    RS.answer_batch(spark.createDataFrame([(1, serial, ["R2"]), (2, "nowhere", [])], REQUESTS), 0, sets, RS.model_scorer("rf", "model"), sink, AS_OF)
    by = {r["request_id"]: r for r in spark.read.parquet(sink).collect()}
    assert abs(sum(by[1]["prediction"]["risk_probabilities"].values()) - 1) < 1e-3 and by[2]["prediction"] is None
