"""Energy of intervals and of runs, from counter samples(node_id, domain, ts, sample_id, energy_uj).

A counter that falls has wrapped once at max_range. Samples without a time are no samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTER = ("node_id", "domain")
DAY = 86_400


def step(now: Column, before: Column, max_range: int | None) -> Column:
    """Microjoules between two readings."""
    return now - before if max_range is None else F.when(now < before, now - before + max_range).otherwise(now - before)


def interval_joules(samples: DataFrame, intervals: DataFrame, key: list[str], begin: str, end: str, max_range: int | None = None) -> DataFrame:
    """(key, domain, joules) of every interval and every domain of its node: what the counter gained from the last reading at or before
    `begin` to the last at or before `end`. Null where there is no reading before `begin`, or the interval ends before it begins.

    intervals have node_id among `key`, whose columns name an interval. Both ends join the samples in one order by node, domain and time; one
    pass carries the counter's prefix sum, and an end takes the sum as of its time. So samples are sorted once and intervals may overlap
    at no cost but their own two rows.
    """
    c = F.col
    # Intervals and counters grow with the fleet: neither side of these joins may be broadcast.
    names = samples.select(*COUNTER).distinct().hint("merge")
    ends = intervals.filter(c(begin) <= c(end)).select(*key, F.inline(F.array(F.struct(F.lit("b").alias("side"), c(begin).cast("timestamp_ntz").alias("ts")), F.struct(F.lit("e").alias("side"), c(end).cast("timestamp_ntz").alias("ts"))))).join(names, "node_id")
    readings = samples.filter("ts IS NOT NULL").select(*COUNTER, c("ts").cast("timestamp_ntz").alias("ts"), "sample_id", c("energy_uj").alias("uj"))
    both = readings.unionByName(ends, allowMissingColumns=True).withColumn("kind", F.when(c("side").isNull(), 0).otherwise(1))
    order = Window.partitionBy(*COUNTER).orderBy("ts", "kind", "sample_id")
    before = F.last("uj", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("step", F.when(c("side").isNull(), F.coalesce(step(c("uj"), before, max_range), F.lit(0))))
    so_far = rows.withColumn("total", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("side IS NOT NULL")
    at = lambda side: F.max(F.when(c("side") == side, c("total")))
    found = so_far.groupBy(*key, "domain").agg(((at("e") - at("b")) / 1e6).alias("joules"))
    return intervals.select(*key).join(names, "node_id").join(found.hint("merge"), [*key, "domain"], "left")


def within(samples: DataFrame, intervals: DataFrame, on: str, at: str, begin: str, end: str, width: int = DAY) -> DataFrame:
    """samples joined to every interval of the same `on` that holds their time, both ends included.

    An interval is named once for each stretch of `width` seconds that it touches, a sample's stretch is where it lies; the join is an equality on
    both, so a node with very many samples is split over its stretches. Choose a width near the intervals' length.
    """
    c = F.col
    stretch = lambda t: F.floor(F.unix_seconds(c(t).cast("timestamp")) / width)
    named = intervals.filter(c(begin) <= c(end)).withColumn("stretch", F.explode(F.sequence(stretch(begin), stretch(end))))
    rows = samples.filter(c(at).isNotNull()).withColumn("stretch", stretch(at))
    # Spark takes the exploded intervals for as small as the intervals, and would broadcast them.
    return rows.join(named.hint("merge"), [on, "stretch"]).filter(c(at).between(c(begin), c(end))).drop("stretch")


def run_energy(samples: DataFrame, runs: DataFrame, max_range: int | None = None, width: int = DAY) -> DataFrame:
    """(node_id, run_no, domain, joules, first, last, n) of runs(node_id, run_no, begin_at, end_at), from the samples within each run."""
    c = F.col
    rows = within(samples.withColumn("at", c("ts").cast("timestamp_ntz")), runs.select("node_id", "run_no", c("begin_at").cast("timestamp_ntz").alias("begin_at"), c("end_at").cast("timestamp_ntz").alias("end_at")), "node_id", "at", "begin_at", "end_at", width)
    order = Window.partitionBy("node_id", "run_no", "domain").orderBy("at", "sample_id")
    steps = rows.withColumn("step", step(c("energy_uj"), F.lag("energy_uj").over(order), max_range))
    return steps.groupBy("node_id", "run_no", "domain").agg((F.coalesce(F.sum("step"), F.lit(0)) / 1e6).alias("joules"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def edp(samples: DataFrame, runs: DataFrame, domains: DataFrame, level: str = "package", max_range: int | None = None, width: int = DAY) -> DataFrame:
    """(node_id, run_no, joules, seconds, edp): energy-delay product of each run with samples, in joule-seconds. The energy is that of the
    domains of one level, as levels overlap; the delay is from the first to the last of their samples. domains: a handful of rows."""
    c = F.col
    kept = domains.filter(c("level") == level).select("domain")
    rows = run_energy(samples.join(F.broadcast(kept), "domain", "left_semi"), runs, max_range, width).groupBy("node_id", "run_no").agg(F.sum("joules").alias("joules"), (F.timestamp_diff("MICROSECOND", F.min("first"), F.max("last")) / 1e6).alias("seconds"))
    return rows.withColumn("edp", c("joules") * c("seconds"))
