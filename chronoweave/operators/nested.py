"""Nested values of any depth: taken apart to paths, rewritten, put together again, and searched for keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import written

# Keys and values that must not leave a run, and keys that a live configuration must not have.
SECRET_KEY = r"(?i)(?:api[_-]?key|token|authorization|secret|password)"
SECRET_VALUE = r"(?i)\b(?:sk-[A-Za-z0-9_-]{8,}|bearer\s+[A-Za-z0-9._~+/-]{8,})\b"
MARK = "<redacted>"
FORBIDDEN_KEY = r"(?i)video_\d+(?:_.+)?"


def taken_apart(documents: DataFrame, id: str, value: str) -> DataFrame:
    """id, path, kind, key, place, text: every node of VARIANT documents, to whatever depth they have.

    `path` is the array of keys and of numbers of list items from the root (an empty array) on, `place` the number of a list
    item; `kind` is object, array or value, `text` the JSON of a value. Each level is one pass over the nodes of the
    last and is written, so that neither depth nor width is held in one task. Null documents have no node.
    """
    shape = F.expr("schema_of_variant(node)")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("value")
    node = documents.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("place"), F.col(value).alias("node"))
    found = None
    while True:
        level = written(node.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "value", F.to_json("node"))), "nodes")
        found = level.drop("node") if found is None else found.unionByName(level.drop("node"))
        if level.where("kind <> 'value'").isEmpty():
            return found
        below = lambda step: F.concat("path", F.array(step)).alias("path")
        items = level.where("kind = 'array'").select("id", "path", F.posexplode(F.expr("cast(node as array<variant>)")).alias("place", "node"))
        fields = level.where("kind = 'object'").select("id", "path", F.explode(F.expr("cast(node as map<string, variant>)")).alias("key", "node"))
        node = items.select("id", below(F.col("place").cast("string")), F.lit(None).cast("string").alias("key"), "place", "node").unionByName(fields.select("id", below(F.col("key")), "key", F.lit(None).cast("int").alias("place"), "node"))


def put_together(nodes: DataFrame) -> DataFrame:
    """id, body: the JSON of each document of `taken_apart` nodes, keys in order, from the deepest level upwards.

    What a group gathers is the JSON of one node, so that the largest is a document's.
    """
    nodes = written(nodes, "nodes")
    deepest = nodes.agg(F.max(F.size("path"))).first()[0]
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("key").alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    below = None
    for depth in range(deepest or 0, -1, -1):
        level = nodes.where(F.size("path") == depth)
        if below is None:
            level = level.withColumn("inner", F.lit(None).cast("string"))
        else:
            level = level.alias("n").join(below.alias("b"), F.col("n.id").eqNullSafe(F.col("b.id")) & (F.col("n.path") == F.col("b.path")), "left").select("n.*", "b.inner")
        inner = F.coalesce("inner", F.lit(""))
        body = F.when(F.col("kind") == "value", F.col("text")).when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
        level = level.withColumn("body", body)
        if depth:
            part = F.when(F.col("key").isNull(), F.col("body")).otherwise(F.concat(quoted, F.lit(":"), F.col("body")))
            parts = F.sort_array(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("p"), F.coalesce("key", F.lit("")).alias("k"), part.alias("t"))))
            up = F.slice("path", 1, F.size("path") - 1)
            below = written(level.withColumn("_up", up).groupBy("id", F.col("_up").alias("path")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ",").alias("inner")), "nested")
    return level.select("id", "body")


def rewritten(nodes: DataFrame, gone: Column, text: Column) -> DataFrame:
    """Nodes where those of `gone` become the mark, without what is below them, and the text of values becomes `text`."""
    marked = nodes.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    top = marked.where("_gone").select("id", F.col("path").alias("_top"))
    # a node goes with any of the nodes above it: an equality join with their paths
    above = marked.where(F.size("path") > 0).select("id", "path", F.explode(F.expr("transform(sequence(0, size(path) - 1), n -> slice(path, 1, n))")).alias("_top"))
    same = lambda a, b, c: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    lost = above.alias("x").join(top.alias("t"), same("x", "t", "_top"), "left_semi").select("id", "path").distinct()
    kept = marked.alias("m").join(lost.alias("l"), same("m", "l", "path"), "left_anti")
    return kept.withColumns({"kind": F.when(F.col("_gone"), "value").otherwise(F.col("kind")), "text": F.when(F.col("_gone"), F.lit(f'"{MARK}"')).otherwise(text)}).drop("_gone")


def redacted_documents(documents: DataFrame, id: str, value: str) -> DataFrame:
    """id and body: VARIANT documents as JSON with the values of secret keys, whatever they hold, and secrets in texts replaced by a mark.

    Keys come back in order. `id` tells documents apart. Null documents give no row.
    """
    cleaned = F.when(F.col("text").startswith('"'), F.regexp_replace("text", SECRET_VALUE, MARK)).otherwise(F.col("text"))
    return put_together(rewritten(taken_apart(documents, id, value), F.col("key").rlike(SECRET_KEY), cleaned))


def forbidden_paths(documents: DataFrame, id: str, value: str, keys: list[str], pattern: str = FORBIDDEN_KEY, root: str = "") -> DataFrame:
    """id and path (keys joined by dots, `root` before them) of every key, at any depth, that is one of `keys` or matches `pattern` as a whole."""
    bad = F.col("key").isin(*keys) | F.col("key").rlike(f"^(?:{pattern})$")
    path = F.array_join(F.concat(F.array(F.lit(root)), "path") if root else F.col("path"), ".")
    return taken_apart(documents, id, value).where(F.col("key").isNotNull() & bad).select("id", path.alias("path"))
