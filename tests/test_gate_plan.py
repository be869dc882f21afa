"""An artifact's text is parsed once, whatever is asked of its errors."""

from pyspark.sql import functions as F

from chronoweave.operators import gate


def test_parsed_once(spark):
    rows = spark.createDataFrame([(1, "frame_manifest", '{"frames":5}'), (2, "other", "{}"), (3, "frame_manifest", "[1]"), (4, None, "{"), (5, None, "{}")], "event_id long, type string, body string")
    found = gate.checked_artifacts(rows, "type", "body").select("event_id", F.explode("errors").alias("error"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    got = [(r.event_id, r.error) for r in found.orderBy("event_id").collect()]
    assert got == [(1, "MISSING_REQUIRED_FIELD"), (1, "INVALID_FRAMES"), (2, "UNKNOWN_ARTIFACT_TYPE"), (3, "INVALID_ROOT_TYPE"), (4, "JSON_PARSE_ERROR"), (5, "UNKNOWN_ARTIFACT_TYPE")]
