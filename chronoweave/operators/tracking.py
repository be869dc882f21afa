"""Tracks and pairs in the plane: groups by gaps, tracking out from the best anchor, nearest pairs by growing grids, role collisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import box_iou
from chronoweave.operators.folds import Fold, folded
from chronoweave.session import written


def gap_groups(rows: DataFrame, at: str, gap: Column | int, keys: tuple[str, ...] = ("entity",), order: tuple[str, ...] = ("event_id",), name: str = "group_no") -> DataFrame:
    """Number the groups of a key's rows from 0 on: a row more than `gap` behind the one before begins another."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False))
    return rows.withColumn(name, F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


# ---- W20: out from the best anchor


@dataclass(frozen=True)
class Limits:
    """What a step and a result must meet; scores in thousandths, distances in pixels."""

    reach: float = 90.0
    per_pixel: float = 360.0
    least: int = 240
    least_alike: int = 340
    #: A result below `weak` must not have come from farther than `near`, one below `sure` must look alike by `alike`.
    weak: int = 340
    near: float = 28.0
    sure: int = 400
    alike: int = 650


class Outwards(Fold):
    """From the anchor to one side: at each frame the best candidate near the last accepted one, if it is good enough."""

    def __init__(self, limits: Limits):
        self.limits, self.x, self.y = limits, None, None

    def row(self, r):
        if r["away"] == 0:
            self.x, self.y = r["anchor"]["x"], r["anchor"]["y"]
            return [(r["entity"], r["group_no"], r["frame"], r["anchor"]["event_id"], 0.0, r["anchor"]["score"], r["anchor"]["alike"])] if r["side"] > 0 else []
        best = None
        for c in r["candidates"]:  # best score first, so that the first of equals wins
            gap = math.hypot(c["x"] - self.x, c["y"] - self.y)
            rank = c["score"] / 1000.0 - gap / self.limits.per_pixel
            if gap <= self.limits.reach and (best is None or rank > best[0]):
                best = (rank, gap, c)
        if best is None or best[2]["score"] < self.limits.least or best[2]["alike"] < self.limits.least_alike:
            return []
        _, gap, c = best
        self.x, self.y = c["x"], c["y"]
        return [(r["entity"], r["group_no"], r["frame"], c["event_id"], gap, c["score"], c["alike"])]


def tracked_outwards(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """entity, group_no, frame, event_id, step, score, alike of one track in each group of candidates (entity, group_no, frame, event_id, x, y, score, alike).

    The anchor is the candidate of the best score, the earliest and then the smallest id among several. From it two folds
    go to the later and to the earlier frames, each step chosen against the last accepted one; frames without a good
    candidate are passed over. Weak results are dropped at the end. Rows with a null in a column take no part. A fold holds one
    frame's candidates.
    """
    used = rows.select("entity", "group_no", "frame", "event_id", "x", "y", "score", "alike").dropna(subset=["frame", "event_id", "x", "y", "score", "alike"])
    one = F.struct((-F.col("score")).alias("less"), "event_id", "x", "y", "score", "alike")
    frames = used.groupBy("entity", "group_no", "frame").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    top = F.max_by(F.struct("frame", "event_id", "x", "y", "score", "alike"), F.struct("score", -F.col("frame"), -F.col("event_id")))
    anchors = used.groupBy("entity", "group_no").agg(top.alias("anchor"))
    met = frames.alias("f").join(anchors.alias("a"), F.col("f.entity").eqNullSafe(F.col("a.entity")) & F.col("f.group_no").eqNullSafe(F.col("a.group_no"))).select("f.*", "anchor")
    met = met.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("away", (F.col("frame") - F.col("anchor.frame")) * F.col("side")).where("away >= 0")
    kind = {f.name: f.dataType.simpleString() for f in used.schema.fields}
    out = f"entity {kind['entity']}, group_no {kind['group_no']}, frame {kind['frame']}, event_id {kind['event_id']}, step double, score {kind['score']}, alike {kind['alike']}"
    track = folded(met, ["entity", "group_no", "side"], ["away"], lambda: Outwards(limits), out)
    weak = (F.col("score") < limits.weak) & (F.col("step") > limits.near)
    unsure = (F.col("score") < limits.sure) & ~((F.col("score") >= limits.weak) & (F.col("alike") >= limits.alike))
    return track.where(~weak & ~unsure)


# ---- J18: nearest pairs by grids that grow


def squared(a: str, b: str, x: str, y: str) -> Column:
    dx, dy = F.col(f"{a}.{x}") - F.col(f"{b}.{x}"), F.col(f"{a}.{y}") - F.col(f"{b}.{y}")
    return dx * dx + dy * dy


def met_on_grid(left: DataFrame, right: DataFrame, keys: list[str], at: list[str], side: Column | float) -> DataFrame:
    """Pairs (structs a, b) of rows of a key whose cells of that side touch, over all axes of `at`: an equality join with neighbour cells on the right."""
    a, b = left.select(F.struct("*").alias("a")), right.select(F.struct("*").alias("b"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    for i, axis in enumerate(at):
        cell = lambda row, axis=axis: F.floor(F.col(f"{row}.{axis}") / side)
        a = a.withColumn(f"_a{i}", cell("a"))
        b = b.withColumn(f"_b{i}", F.explode(F.array(*(cell("b") + k for k in (-1, 0, 1)))))
        on.append(F.col(f"_a{i}") == F.col(f"_b{i}"))
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return a.join(b, condition).select("a", "b")


def nearest_in_plane(left: DataFrame, right: DataFrame, keys: list[str], id: str, reach: int, *, x: str = "x", y: str = "y", levels: int = 5) -> DataFrame:
    """keys, left_id, right_id, squared: the nearest right row of each left row within `reach`, the smaller id among several.

    Cells begin at a small part of the reach and double; a left row that has a right one within a cell's side is done, as
    all that are as near lie in neighbour cells. So only rows without near partners meet large cells. Rows with a null
    place meet nothing; ids of a side tell its rows apart.
    """
    names = [*keys, id, x, y]
    left, right = (r.select(*names).dropna(subset=[id, x, y]) for r in (left, right))
    found, kept = None, [f"a.{k}" for k in keys]
    for level in range(levels):
        side = reach / 2 ** (levels - 1 - level)
        near = met_on_grid(left, right, keys, [x, y], side).select("a", F.col(f"b.{id}").alias("right_id"), squared("a", "b", x, y).alias("squared")).where(F.col("squared") <= side * side)
        best = near.groupBy(*(F.col(k) for k in kept), F.col(f"a.{id}").alias("left_id")).agg(F.min(F.struct("squared", "right_id")).alias("best"))
        here = written(best.select(*keys, "left_id", "best.right_id", "best.squared"), "nearest")
        found = here if found is None else found.unionByName(here)
        left = left.join(here.select(F.col("left_id").alias(id)), id, "left_anti")
    return found


def nearest_apart(left: DataFrame, right: DataFrame, keys: list[str], id: str, at: str, reach: int, apart: int, quality: str, *, x: str = "x", y: str = "y", levels: int = 5) -> DataFrame:
    """keys, left_id, right_id, gap, quality: of each key the pair that is nearest in time, at most `reach` apart, and at least `apart` in the plane.

    Among pairs as near the higher sum of `quality` wins, then the smaller ids. Buckets of time begin small and double, and
    a key with a pair within one is done; so only keys without near pairs meet wide buckets. Rows with a null take no part.
    """
    names = [*keys, id, at, x, y, quality]
    left, right = (r.select(*names).dropna(subset=[id, at, x, y, quality]) for r in (left, right))
    found = None
    for level in range(levels):
        side = reach / 2 ** (levels - 1 - level)
        gap = F.abs(F.col(f"a.{at}") - F.col(f"b.{at}"))
        pairs = met_on_grid(left, right, keys, [at], side).withColumn("gap", gap).where((F.col("gap") <= side) & (squared("a", "b", x, y) >= apart * apart))
        one = F.struct("gap", (-(F.col(f"a.{quality}") + F.col(f"b.{quality}"))).alias("less"), F.col(f"a.{id}").alias("left_id"), F.col(f"b.{id}").alias("right_id"))
        best = pairs.groupBy(*(F.col(f"a.{k}") for k in keys)).agg(F.min(one).alias("best"))
        here = written(best.select(*keys, "best.left_id", "best.right_id", "best.gap", (-F.col("best.less")).alias("quality")), "apart")
        found = here if found is None else found.unionByName(here)
        left = left.join(here.select(*keys), keys, "left_anti")
    return found


# ---- J26: two roles on one face


def resolved_collisions(pairs: DataFrame, first: str, second: str, strength: str, *, overlap: float, ratio: float) -> DataFrame:
    """pairs with `iou`, and whether `first` and `second` (structs x0, y0, x1, y1 and a strength) are kept, and why not.

    Boxes that overlap by `overlap` or more are one face: the one `ratio` times as strong stays, else neither does. Apart,
    the first must lie left of the second by its centre. A null box leaves both as they are.
    """
    a, b = F.col(f"{first}.{strength}"), F.col(f"{second}.{strength}")
    clash = F.col("iou") >= overlap
    decided = (F.least(a, b) > 0) & (F.greatest(a, b) >= ratio * F.least(a, b))
    swapped = F.col(f"{first}.x0") + F.col(f"{first}.x1") >= F.col(f"{second}.x0") + F.col(f"{second}.x1")
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    why = F.when(~both, F.lit(None).cast("string")).when(clash & decided, "weaker").when(clash, "ambiguous").when(swapped, "order")
    rows = pairs.withColumn("iou", F.when(both, box_iou(first, second))).withColumn("reason", why)
    lost = lambda mine, other: F.coalesce(F.col("reason").isin("ambiguous", "order") | ((F.col("reason") == "weaker") & (mine < other)), F.lit(False))
    return rows.withColumns({f"{first}_kept": F.col(first).isNotNull() & ~lost(a, b), f"{second}_kept": F.col(second).isNotNull() & ~(lost(b, a) | F.coalesce((F.col("reason") == "weaker") & (a == b), F.lit(False)))})
