"""Graphs held as tables of links: connected components and what can be reached along directed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the smallest node that links lead to, in either direction.

    Each round hangs every node under the smallest label among its own and its neighbours' and then follows labels twice
    as far as before. A label only falls and names a node of the same component; rounds grow with the logarithm of the
    longest chain of labels. Minima are aggregated before they are shuffled, and joins are on nodes, so that a star's
    centre is split like any skewed key. Links with a null end are left out, nodes without a link don't appear.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    edges = written(known.unionByName(known.selectExpr("b as a", "a as b")).distinct(), "links")
    label = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # edges between labels: hook the larger of two roots below the smaller
        ends = edges.join(label.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
        cross = ends.where("la > lb").groupBy(F.col("la").alias("node")).agg(F.min("lb").alias("hook"))
        moved = written(label.join(cross, "node", "left").select("node", F.least("label", F.coalesce("hook", "label")).alias("label"), F.col("hook").isNotNull().alias("hooked")), "labels")
        if moved.where("hooked").isEmpty() and moved.join(moved.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").where("up < label").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("up"))
        once = moved.select("node", "label").join(up, "label").select("node", F.col("up").alias("label"))
        label = written(once.join(up, "label").select("node", F.col("up").alias("label")), "labels")


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, steps): every node that directed links (a, b) lead to from the nodes of `starts` (start), by the least number of steps.

    A start reaches itself in no steps. Each round follows the links of the nodes that the last one found first, until
    none is new; cycles end by themselves. Rows are as many as there are pairs to tell of.
    """
    links = written(links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct(), "links")
    front = starts.where(F.col("start").isNotNull()).select("start", F.col("start").alias("node"), F.lit(0).alias("steps")).distinct()
    known, steps = written(front, "reached"), 0
    front = known
    while not front.isEmpty():
        steps += 1
        ahead = front.join(links, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = written(ahead.join(known, ["start", "node"], "left_anti").withColumn("steps", F.lit(steps)), "front")
        known = known.unionByName(front)
    return known


def producer_plan(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """tool, call_no, products, wanted, first_product: the tools that produce something wanted, each called once, in the order of their first place.

    `made` has (tool, produced, pos), `wanted` (produced); what a tool makes beside is counted in `products`. A product that a tool
    names several times counts once. Places number one row a tool, which is what the last window orders.
    """
    once = made.dropna(subset=["tool", "produced"]).groupBy("tool", "produced").agg(F.min("pos").alias("pos"))
    asked = wanted.select("produced").dropna().distinct().withColumn("_asked", F.lit(1))
    tools = once.join(asked, "produced", "left").groupBy("tool").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("products"), F.count("_asked").alias("wanted"), F.min("produced").alias("first_product"))
    tools = tools.where("wanted > 0")
    return tools.withColumn("call_no", F.row_number().over(Window.orderBy("pos", "tool"))).drop("pos")
