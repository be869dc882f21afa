"""Runs appear whole or not at all, are never written again, and are read by shape in planned pieces."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import runs as R


def rows(spark, n=50):
    return spark.range(n).select((F.col("id") % 7).alias("video_id"), F.concat(F.lit("text é "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n")).repartition(3)


def back(df):
    return sorted((r.entity, json.loads(r.item)["text"], json.loads(r.item).get("n")) for r in df.collect())


def test_a_run_comes_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "ITEMS", 4)
    path = str(tmp_path)
    R.write_run(rows(spark), path, "first", "video_id")
    R.write_run(rows(spark, 5), path, "second", "video_id")
    want = sorted((str(i % 7), f"text é {i}", i if i % 2 == 0 else None) for i in range(50))
    assert back(R.read_runs(spark, path, run="first")) == want
    got = R.read_runs(spark, path, "text string, n long")
    assert {(r.run, r["count"]) for r in got.groupBy("run").count().collect()} == {("first", 50), ("second", 5)}
    assert sorted((r.entity, r.item.text, r.item.n) for r in got.where("run = 'first'").collect()) == want
    manifest = json.loads((tmp_path / "first" / R.MANIFEST).read_text())
    assert manifest["items"] == 50 and sum(f["items"] for f in manifest["files"]) == 50
    for f in manifest["files"]:
        body = (tmp_path / "first" / f["name"]).read_bytes()
        assert hashlib.sha256(body).hexdigest() == f["sha256"] and len(body) == f["bytes"]
    assert {f["name"] for f in manifest["files"]} | {R.MANIFEST} == set(os.listdir(tmp_path / "first"))


def test_reading_is_planned_by_size(spark, tmp_path):
    path = str(tmp_path)
    for k in range(4):
        R.write_run(rows(spark), path, f"run{k}", "video_id")
    few = R.RunReader({"path": path}).partitions()
    many = R.RunReader({"path": path, "splitbytes": "1"}).partitions()
    assert len(few) == 1 and len(many) == len(few[0].documents) == sum(len(p.documents) for p in many) > 4
    assert R.read_runs(spark, path, splitBytes="1").rdd.getNumPartitions() == len(many)
    assert R.read_runs(spark, path, splitBytes="1").count() == 200


def test_a_run_whose_task_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    broken = rows(spark).withColumn("text", F.when(F.col("n") == 48, F.raise_error(F.lit("on purpose"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="on purpose"):
        R.write_run(broken, path, "one", "video_id")
    assert [x for x in os.listdir(path)] == []
    assert R.read_runs(spark, path).collect() == []
    R.write_run(rows(spark), path, "one", "video_id")  # the name is still free
    assert R.read_runs(spark, path).count() == 50


def test_a_run_is_never_written_again(spark, tmp_path):
    path = str(tmp_path)
    R.write_run(rows(spark), path, "one", "video_id")
    was = {f: (tmp_path / "one" / f).read_bytes() for f in os.listdir(tmp_path / "one")}
    with pytest.raises(Exception, match="exists"):
        R.write_run(rows(spark, 3), path, "one", "video_id")
    with pytest.raises(Exception, match="never written again"):
        rows(spark).selectExpr("'a' as entity", "'{}' as item").write.format("runs").mode("overwrite").options(path=path, run="two").save()
    for name in ("", "a/b", ".hidden", "x" * 101, "ü"):
        with pytest.raises(Exception, match="name"):
            R.write_run(rows(spark, 3), path, name, "video_id")
    assert {f: (tmp_path / "one" / f).read_bytes() for f in os.listdir(tmp_path / "one")} == was and os.listdir(path) == ["one"]


def test_runs_that_are_not_whole_or_were_changed(spark, tmp_path):
    path = str(tmp_path)
    R.write_run(rows(spark), path, "one", "video_id")
    for name in ("half", ".one.staging"):  # as left by a writer that died
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-00000.json").write_text('{"videos":[{"video_id":"9"}]}')
    (tmp_path / ".one.staging" / R.MANIFEST).write_text('{"files":[]}')
    assert R.read_runs(spark, path).count() == 50
    first = next(f for f in os.listdir(tmp_path / "one") if f.startswith("part-"))
    body = (tmp_path / "one" / first).read_bytes()
    (tmp_path / "one" / first).write_bytes(body.replace(b"text", b"tixt"))
    with pytest.raises(Exception, match="manifest"):
        R.read_runs(spark, path).collect()


def test_an_empty_run_and_rows_without_an_entity(spark, tmp_path):
    path = str(tmp_path)
    R.write_run(rows(spark).where("false"), path, "empty", "video_id")
    assert R.read_runs(spark, path).collect() == [] and os.listdir(path) == ["empty"]
    R.write_run(rows(spark, 4).withColumn("video_id", F.when(F.col("n") == 2, "x")), path, "some", "video_id")
    assert [r.entity for r in R.read_runs(spark, path).collect()] == ["x"]


def test_documents_are_told_apart_by_their_shape(spark, tmp_path):
    shapes = {
        "a.json": {"videos": [{"video_id": 1, "v": "a"}, "noise", {"v": "nobody"}]},
        "b.json": {"records": [{"video_id": "2", "v": "b"}]},
        "c.json": {"predictions": [{"video_id": "3", "rubric_stage": 8, "v": "c"}, {"video_id": "4", "rubric_stage": 7, "v": "no"}]},
        "video_5/result.json": {"v": "e"},
        "video_6/result.json": {"video_id": "six", "v": "f"},
    }
    for name, document in shapes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if name == "a.json" else b"") + json.dumps(document).encode())
    got = {r.entity: json.loads(r.item)["v"] for r in R.read_runs(spark, str(tmp_path), pattern="*.json").collect()}
    assert got == {"1": "a", "2": "b", "3": "c", "5": "e", "six": "f"}
    (tmp_path / "video_7").mkdir()
    (tmp_path / "video_7" / "result.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"other": 1}')
    assert {r.entity for r in R.read_results(spark, str(tmp_path)).collect()} == {"5", "six"}
    with pytest.raises(Exception, match="no shape"):
        R.read_runs(spark, str(tmp_path), pattern="d.json").collect()
    assert R.read_runs(spark, str(tmp_path), pattern="d.json", broken="skip").collect() == []


def test_summary(spark, tmp_path):
    path = str(tmp_path / "s")
    R.write_summary(rows(spark).select("video_id", "n"), path, ["video_id", "n"], {"rows": "count(*)", "most": "max(n)"})
    lines, totals = R.read_summary(spark, path, "video_id long, n long")
    assert lines.count() == 50 and totals.select("rows", "most").first() == (50, 48)
    with pytest.raises(Exception, match="(?i)exist"):
        R.write_summary(rows(spark), path, ["n"], {"rows": "count(*)"})
