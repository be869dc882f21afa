"""Windows and samples generated from spans, and rows picked from ordered ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping_windows(spans: DataFrame, length: int = 60, overlap: int = 10) -> DataFrame:
    """Windows from each span's start on, the last one cut at its end; none begins once the end is covered."""
    stride = length - overlap
    extra = F.greatest(F.lit(0), F.ceil((F.col("end_s") - F.col("start_s") - length) / stride))
    rows = spans.where("end_s > start_s").withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("long"), extra.cast("long"))))
    low = F.col("start_s") + F.col("window_no") * stride
    return rows.select("entity", "window_no", low.alias("from_s"), F.least(low + length, F.col("end_s")).alias("to_s"))


def regular_times(spans: DataFrame, step: int) -> DataFrame:
    """Times every `step` from start to end, the end included."""
    times = F.array_distinct(F.concat(F.sequence("start_s", "end_s", F.lit(step).cast("long")), F.array("end_s")))
    return spans.where("end_s >= start_s").select("entity", F.explode(times).alias("at_s"))


def tumbling(rows: DataFrame, at: str, start: Column, length: int = 60) -> DataFrame:
    return rows.withColumn("minute", F.floor((F.col(at) - start) / length))


def uniform_pick(rows: DataFrame, order: list[str], n: int, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """n rows of each key spread evenly over its order, both ends kept; all rows where there are no more than n."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # positions k * (count - 1) / (n - 1), halves to the even neighbour
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(k.cast("double") * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return rows.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def bucket_round_robin(rows: DataFrame, at: str, start: Column, width: Column, buckets: int, order: list) -> DataFrame:
    """Rank rows of an entity by turns over time buckets: the best of each bucket, then the second of each, and so on."""
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col(at) - start) / width))).cast("long")
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("depth", F.row_number().over(Window.partitionBy("entity", "bucket").orderBy(*order)).cast("long"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("depth", "bucket")).cast("long"))


def bucket_peaks(rows: DataFrame, bucket: str, score: str, order: list, percent: int = 25) -> DataFrame:
    """The best row of each bucket, and of those the top `percent` of the entity's buckets (rounded down, at least one)."""
    peak = rows.withColumn("_r", F.row_number().over(Window.partitionBy("entity", bucket).orderBy(F.col(score).desc(), *order))).where("_r = 1")
    peak = peak.withColumns({"_k": F.row_number().over(Window.partitionBy("entity").orderBy(F.col(score).desc(), *order)), "_n": F.count(F.lit(1)).over(Window.partitionBy("entity"))})
    return peak.where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_r", "_k", "_n")


def ranked_union(rows: DataFrame, rankings: list[tuple[list, int]], limit: int, order: list) -> DataFrame:
    """Rows that are among the first of any ranking, at most `limit` of an entity, those of earlier rankings first."""
    w = Window.partitionBy("entity")
    rows = rows.withColumns({f"_r{i}": F.row_number().over(w.orderBy(*by)) for i, (by, _) in enumerate(rankings)})
    tier = F.coalesce(*(F.when(F.col(f"_r{i}") <= n, F.lit(i)) for i, (_, n) in enumerate(rankings)))
    rows = rows.withColumn("tier", tier.cast("long")).where("tier is not null")
    rows = rows.withColumn("_k", F.row_number().over(w.orderBy("tier", *order))).where(F.col("_k") <= limit)
    return rows.drop("_k", *(f"_r{i}" for i in range(len(rankings))))


def around(rows: DataFrame, at: str, low: Column, high: Column, before: int = 2, after: int = 3) -> DataFrame:
    """The last rows before and the first rows after an interval of each entity."""
    side = F.when(F.col(at) < low, -1).when(F.col(at) > high, 1)
    rows = rows.withColumn("side", side.cast("long")).where("side is not null")
    rank = F.row_number().over(Window.partitionBy("entity", "side").orderBy(F.col(at) * -F.signum("side") * -1, "event_id"))
    return rows.withColumn("_k", rank).where((F.col("_k") <= before) & (F.col("side") < 0) | (F.col("_k") <= after) & (F.col("side") > 0)).drop("_k")


def local_maxima(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Rows above the one before and not below the one after; ends compare with what they have."""
    w = Window.partitionBy("entity").orderBy(*order)
    low, high = F.lag(value).over(w), F.lead(value).over(w)
    return rows.withColumns({"_l": low, "_h": high}).where(F.coalesce(F.col(value) > F.col("_l"), F.lit(True)) & F.coalesce(F.col(value) >= F.col("_h"), F.lit(True))).drop("_l", "_h")


def budget_round_robin(windows: DataFrame, budget: int) -> DataFrame:
    """Share a budget of samples over an entity's windows: one each by priority, then by turns until it is spent."""
    rows = windows.withColumn("turn", F.explode(F.sequence(F.lit(1), "capacity")))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("turn", "priority", "window_no"))).where(F.col("_k") <= budget).groupBy("entity", "window_no").agg(F.count(F.lit(1)).alias("samples"))


def phase_aligned(spans: DataFrame, step: int, phase: int) -> DataFrame:
    """Times of each span that are `phase` modulo `step`."""
    first = F.col("start_s") + F.pmod(phase - F.col("start_s"), F.lit(step))
    return spans.withColumn("_first", first).where("_first <= end_s").select("entity", F.explode(F.sequence("_first", "end_s", F.lit(step).cast("long"))).alias("at_s"))


def half_open_buckets(spans: DataFrame, step: int) -> DataFrame:
    """Buckets [from, to) of each span that cover all of it."""
    count = F.ceil((F.col("end_s") - F.col("start_s")) / step)
    rows = spans.where("end_s > start_s").withColumn("bucket_no", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    return rows.select("entity", "bucket_no", (F.col("start_s") + F.col("bucket_no") * step).alias("from_s"), F.least(F.col("start_s") + (F.col("bucket_no") + 1) * step, F.col("end_s")).alias("to_s"))


def overlapping_chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Chunks of `size` rows of each entity, each beginning with the row that the one before ended with."""
    rows = rows.withColumns({"_i": F.row_number().over(Window.partitionBy("entity").orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("entity"))})
    own = F.floor(F.col("_i") / (size - 1))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - 1) / (size - 1)) - 1)
    chunks = F.array_distinct(F.array(F.least(own, last), F.when((F.col("_i") % (size - 1) == 0) & (F.col("_i") > 0), own - 1).otherwise(F.least(own, last))))
    return rows.withColumn("chunk_no", F.explode(chunks)).drop("_i", "_n")


def bursts(anchors: DataFrame, at: str, radius: int, step: int, still: int) -> DataFrame:
    """Distinct times around anchors, each said to be before, during (within `still`) or after its nearest anchor."""
    rows = anchors.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius), F.lit(step))))
    rows = rows.select("entity", (F.col(at) + F.col("_d")).alias("at_s"), F.col("_d").cast("long").alias("_d"))
    near = rows.groupBy("entity", "at_s").agg(F.min_by("_d", F.struct(F.abs(F.col("_d")), "_d")).alias("delta"))
    return near.withColumn("phase", F.when(F.abs(F.col("delta")) <= still, "during").when(F.col("delta") < 0, "before").otherwise("after"))


def role_times(spans: DataFrame, shares: list[int]) -> DataFrame:
    """Times at given hundredths of each span."""
    return spans.select("entity", F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("share"), (F.col("start_s") + F.floor((F.col("end_s") - F.col("start_s")) * p / 100)).alias("at_s")) for p in shares))).alias("r")).select("entity", "r.*")
