"""Runs of JSON artifacts as a data source: written so that a run appears whole or not at all, read in planned pieces.

A run is a folder of JSON documents and `_run.json`, which names them with their sizes and digests and is there only once
the run is whole. Tasks write into a hidden folder beside it; the commit puts the manifest there and renames the folder, an
abort removes it. A run that exists is never written again. The reader takes the documents that manifests name, some MB a
partition, checks their digests and tells their shapes apart by their fields, not by their names.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "run string, path string, entity string, item string"
MANIFEST, NAME = "_run.json", re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
#: Bytes of documents that a partition reads, and items of a document that is written.
SPLIT, ITEMS = 32 << 20, 5000


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are local."""
    if path.startswith("file:"):
        return files.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" not in path:
        return files.LocalFileSystem(), path
    return files.FileSystem.from_uri(path)


def read_bytes(fs: files.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def items_of(document: object, path: str) -> Iterator[tuple[str | None, object]]:
    """(entity, item) of a document, by its shape.

    `videos` or `records`: a list of items by video_id; `predictions`: the same, those of stage 8 alone; else a result of one
    entity, named in it or by its folder. Items that aren't objects or name no entity are left out.
    """
    if not isinstance(document, dict):
        raise ValueError(f"the root of {path} is not an object")
    for field in ("videos", "records", "predictions"):
        if isinstance(document.get(field), list):
            for item in document[field]:
                if isinstance(item, dict) and item.get("video_id") is not None and (field != "predictions" or item.get("rubric_stage") == 8):
                    yield str(item["video_id"]), item
            return
    folder = path.rsplit("/", 2)[-2] if "/" in path else ""
    if document.get("video_id") is None and not folder.startswith("video_"):
        raise ValueError(f"{path} has no shape that is known")
    yield str(document.get("video_id") or folder.removeprefix("video_")), document


@dataclass
class Piece(InputPartition):
    """Documents (run, path, sha256 or None) of one partition."""

    documents: list[tuple[str, str, str | None]]


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern")
        self.run, self.broken = options.get("run"), options.get("broken", "fail")
        self.split = int(options.get("splitbytes", SPLIT))

    def found(self) -> list[tuple[str, str, str | None, int]]:
        fs, root = opened(self.path)
        if self.pattern:  # single documents, as video_*/result.json
            selector = files.FileSelector(root, recursive=True, allow_not_found=True)
            named = [(i.path, i.size) for i in fs.get_file_info(selector) if i.is_file and fnmatch.fnmatch(i.path[len(root.rstrip("/")) + 1 :], self.pattern)]
            return sorted(("", path, None, size) for path, size in named)
        folders = [i for i in fs.get_file_info(files.FileSelector(root, allow_not_found=True)) if i.type == files.FileType.Directory]
        out = []
        for folder in sorted(folders, key=lambda i: i.base_name):
            whole = fs.get_file_info(f"{folder.path}/{MANIFEST}").is_file
            if whole and not folder.base_name.startswith(".") and self.run in (None, folder.base_name):
                manifest = json.loads(read_bytes(fs, f"{folder.path}/{MANIFEST}"))
                out += [(folder.base_name, f"{folder.path}/{f['name']}", f["sha256"], f["bytes"]) for f in manifest["files"]]
        return out

    def partitions(self) -> list[Piece]:
        pieces, now, size = [], [], 0
        for run, path, digest, n in self.found():
            if now and size + n > self.split:
                pieces.append(Piece(now))
                now, size = [], 0
            now.append((run, path, digest))
            size += n
        return [*pieces, Piece(now)] if now else pieces or [Piece([])]

    def read(self, partition: Piece) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for run, path, digest in partition.documents:
            raw = read_bytes(fs, path)
            if digest is not None and hashlib.sha256(raw).hexdigest() != digest:
                raise ValueError(f"{path} is not what its run's manifest says")
            try:
                found = list(items_of(json.loads(raw.decode("utf-8-sig")), path))
            except ValueError:
                if self.broken == "fail":
                    raise
                continue
            for entity, item in found:
                yield run, path.rsplit("/", 1)[-1], entity, json.dumps(item, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@dataclass
class Wrote(WriterCommitMessage):
    files: list[dict]
    items: int


class RunWriter(DataSourceArrowWriter):
    """Rows of (entity, item as JSON text) as documents of at most ITEMS items."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"], options["run"]
        if not NAME.fullmatch(self.run):
            raise ValueError("a run's name has 1 to 100 ASCII letters, digits, dots, dashes or underscores and begins with a letter or digit")
        fs, root = opened(self.path)
        self.target, self.staging = f"{root}/{self.run}", f"{root}/.{self.run}.{uuid.uuid4().hex}"
        if fs.get_file_info(self.target).type != files.FileType.NotFound:
            raise FileExistsError(f"run {self.run} exists")
        fs.create_dir(self.staging, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        fs, _ = opened(self.path)
        context, out, held, count = TaskContext.get(), [], [], 0

        def put():
            body = ('{"schema_version":"run.v1","videos":[\n' + ",\n".join(held) + "\n]}\n").encode()
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(out):05d}.json"
            with fs.open_output_stream(f"{self.staging}/{name}") as f:
                f.write(body)
            out.append({"name": name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "items": len(held)})
            held.clear()

        for batch in iterator:
            for entity, item in zip(batch.column("entity").to_pylist(), batch.column("item").to_pylist(), strict=True):
                held.append(json.dumps({**json.loads(item), "video_id": entity}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
                count += 1
                if len(held) == ITEMS:
                    put()
        if held:
            put()
        return Wrote(out, count)

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, _ = opened(self.path)
        kept = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        names = {f["name"] for f in kept}
        for left in fs.get_file_info(files.FileSelector(self.staging)):
            if left.base_name not in names:  # of attempts that didn't count
                fs.delete_file(left.path)
        body = json.dumps({"run": self.run, "items": sum(m.items for m in messages if m), "files": kept}, indent=1) + "\n"
        with fs.open_output_stream(f"{self.staging}/{MANIFEST}") as f:
            f.write(body.encode())
        if fs.get_file_info(self.target).type != files.FileType.NotFound:
            fs.delete_dir(self.staging)
            raise FileExistsError(f"run {self.run} exists")
        fs.move(self.staging, self.target)

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, _ = opened(self.path)
        if fs.get_file_info(self.staging).type != files.FileType.NotFound:
            fs.delete_dir(self.staging)


class RunSource(DataSource):
    """Format `runs`: options path, run, splitBytes; pattern for single documents; broken=skip to leave out what can't be parsed."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        return RunReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("runs are never written again")
        return RunWriter(dict(self.options))


def read_runs(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """run, path, entity and the item (JSON text, or a struct of `schema`) of every whole run under `path`."""
    spark.dataSource.register(RunSource)
    rows = spark.read.format("runs").options(path=path, **options).load()
    return rows.withColumn("item", F.from_json("item", schema)) if schema else rows


def read_results(spark: SparkSession, path: str, pattern: str = "video_*/result.json") -> DataFrame:
    """path, entity and item of single documents under `path`; those that can't be parsed are left out."""
    return read_runs(spark, path, pattern=pattern, broken="skip").drop("run")


def write_run(rows: DataFrame, path: str, run: str, entity: str) -> None:
    """Write rows as a run: each becomes an item of its fields without nulls, named by its `entity` (text; null is left out when read)."""
    rows.sparkSession.dataSource.register(RunSource)
    item = F.to_json(F.struct(*(c for c in rows.columns if c.lower() != entity.lower())))
    rows.select(F.col(entity).cast("string").alias("entity"), item.alias("item")).write.format("runs").mode("append").options(path=path, run=run).save()


def write_summary(rows: DataFrame, path: str, order: list[str], totals: dict[str, str]) -> None:
    """Rows as CSV with a header, in order, under path/rows, and `totals` (name: SQL aggregate) as one JSON object under path/summary; neither replaces what is there."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    rows.agg(*(F.expr(e).alias(n) for n, e in totals.items())).write.mode("errorifexists").json(f"{path}/summary")


def read_summary(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.option("header", True).schema(schema).csv(f"{path}/rows"), spark.read.json(f"{path}/summary")
