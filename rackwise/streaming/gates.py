"""Streams of facts, reports and energy samples, with the same rules as batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rackwise.operators import from_reports
from rackwise.operators.assess import assess, capability_results
from rackwise.operators.outcomes import experiment_blockers


def stream_gate(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Blockers of a stream of facts: projections only, no state."""
    return experiment_blockers(capability_results(assess(facts), keys))


def start_report_gate(reports: DataFrame, out: str, dead: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Gates a stream of report documents (stream_reports): usable ones go to `out` with their blockers, others to `dead` with the
    reason. A batch owns one folder under each and writes it anew, so a batch that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = from_reports.with_reason(batch).select(from_reports.node().alias("node"), "generated_at", "file_time", "file_path", "experiment_blockers", "reason", "corrupt").persist()
        batch.filter("reason IS NULL").drop("reason", "corrupt").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter("reason IS NOT NULL").select("file_path", "reason", "corrupt").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gated(spark: SparkSession, out: str) -> DataFrame:
    """(node, generated_at, experiment_blockers) of what start_report_gate has written: each run by its newest file, however often it came."""
    rows = spark.read.parquet(out).groupBy("node", "generated_at")
    return rows.agg(F.max_by("experiment_blockers", F.struct("file_time", "file_path")).alias("experiment_blockers"))


def stream_captures(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of deliveries (with received_at) in which each capture comes once: the first delivery of a run's source and item that the stream sees; others
    within `late` of it are passed over, and keys are forgotten after that. Batches take the newest instead (parse.by_run), so a table of what
    this stream writes gives the same facts only where deliveries are equal."""
    return captures.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["node_id", "captured_at", "source", "item"])


ENERGY = "node_id long, domain string, start timestamp, joules double, n long, late long"


def stream_energy(samples: DataFrame, max_range: int | None = None, seconds: int = 3600) -> DataFrame:
    """Energy of a stream of samples by node, domain and window of so many seconds, exact at the windows' edges: (node_id, domain, start, joules,
    n, late), to be added up by window with energy_windows.

    The state of a counter is its last sample, so the step from one window's last sample to the next one's first is known; it counts for the
    window of the later sample, as do wraps at max_range. A sample older than the state came late: it is counted in `late`, and its step
    is part of the one already taken. So the sums over all windows are those of the batch operators.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Most counters have few samples a batch: plain arrays, as each call of pandas costs more than the work on a small group.
        parts = [[f[c].to_numpy() for c in ("ts", "sample_id", "energy_uj")] for f in frames]
        ts, ids, uj = (np.concatenate(p) for p in zip(*parts))
        known = ~(np.isnat(ts) | pd.isna(uj))
        ts, ids, uj = ts[known], ids[known].astype("float64") if ids.dtype == object else ids[known], uj[known].astype("int64")
        if not len(ts):
            return
        order = np.lexsort((ids, ts))
        ts, uj = ts[order], uj[order]
        time = ts.astype("int64")
        at, counter = state.get if state.exists else (None, None)
        # Sorted by time, the late ones come first.
        late = int(np.searchsorted(time, at, "left")) if state.exists else 0
        step = np.zeros(len(ts), "int64")
        if late < len(ts):
            step[late:] = np.diff(uj[late:], prepend=counter if state.exists else uj[late])
            state.update((int(time[-1]), int(uj[-1])))
        if max_range is not None:
            step[step < 0] += max_range
        window = ts.astype("datetime64[s]").astype("int64") // seconds
        first = np.flatnonzero(np.diff(window, prepend=window[0] - 1))
        fresh = np.add.reduceat((np.arange(len(ts)) >= late).astype("int64"), first)
        n = np.diff(first, append=len(ts))
        start = (window[first] * seconds).astype("datetime64[s]").astype(ts.dtype)
        yield pd.DataFrame({"node_id": key[0], "domain": key[1], "start": start, "joules": np.add.reduceat(step, first) / 1e6, "n": fresh, "late": n - fresh})

    rows = samples.select("node_id", "domain", F.col("ts").cast("timestamp").alias("ts"), "sample_id", "energy_uj").groupBy("node_id", "domain")
    return rows.applyInPandasWithState(run, ENERGY, "at long, counter long", "append", GroupStateTimeout.NoTimeout)


def energy_windows(rows: DataFrame) -> DataFrame:
    """What a stream has written, by window."""
    return rows.groupBy("node_id", "domain", "start").agg(F.sum("joules").alias("joules"), F.sum("n").alias("n"), F.sum("late").alias("late"))
