"""Small files are written and read by all tasks, a scan each."""

import re

from chronoweave.plans import source_queries
from chronoweave.plans.registry import QUERIES


def test_media_files_are_written_by_several_tasks_and_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "folder", lambda spark, name: str(tmp_path / "files"))
    spark.createDataFrame([(i // 2, i % 2) for i in range(80)] + [(None, 1)], "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["media_manifest"](spark, str(tmp_path))
    assert sorted(r.conv_id for r in found.collect()) == list(range(0, 40, 2)) and {r.length for r in found.collect()} == {9}
    files = [p for p in (tmp_path / "files").rglob("part-*.txt")]
    assert len(files) == 40 and len({re.match(r"part-(\d+)", p.name)[1] for p in files}) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Join" not in plan
