"""Documents are read once, however deep they are: what is left reads the levels that were written."""

from pyspark.sql import functions as F

from chronoweave.sources import timeline as S


def test_documents_are_read_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text('{"frame_number":%d,"a":[[{"frame_number":7,"b":{"stage":"s","start_seconds":1,"end_seconds":2}}]]}' % i)
    documents = S.read_documents(spark, str(tmp_path / "*.json")).withColumn("path", F.regexp_extract("path", r"(\d)\.json", 1))
    numbers, runs = S.nested_numbers(documents), S.nested_runs(documents)
    for found in (numbers, runs):
        assert not any(str(tmp_path) in f for f in found.inputFiles())
    assert {tuple(r) for r in numbers.collect()} == {(str(i), n) for i in range(3) for n in (i, 7)}
    assert {tuple(r)[:4] for r in runs.collect()} == {(str(i), "s", 1.0, 2.0) for i in range(3)}
