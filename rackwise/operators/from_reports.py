"""Reports, once read, for the fleet: what can't be used is set aside, each run counts once, and gate, plan and comparison follow.

A report's run is (node, generated_at); node is node_id, or the host's name where a report has no node_id. A report may be delivered again:
of one run's documents the newest file counts. Every operator reads only the sections it needs, nested fields included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from rackwise.operators.assess import CAPABILITIES

RUN = ("node", "generated_at")


def node() -> Column:
    return F.coalesce(F.col("node_id").cast("string"), F.nullif(F.col("node.hostname"), F.lit("")))


def with_reason(reports: DataFrame) -> DataFrame:
    """reports(file_path, ...) with `reason`: why a document can't be used; null where it can."""
    c = F.col
    reason = F.when(c("corrupt").isNotNull(), "not a report in JSON").when(c("generated_at").isNull(), "no time").when(node().isNull(), "no node").when(c("capabilities").isNull(), "no capabilities").when(c("experiment_blockers").isNull(), "no blockers").when(c("backends").isNull(), "no backends")
    return reports.withColumn("reason", reason)


def quarantined(reports: DataFrame) -> DataFrame:
    """(file_path, reason, corrupt) of documents that can't be used; corrupt: the text of one that couldn't be parsed."""
    return with_reason(reports).filter("reason IS NOT NULL").select("file_path", "reason", "corrupt")


def sound(reports: DataFrame) -> DataFrame:
    return with_reason(reports).filter("reason IS NULL").drop("reason", "corrupt")


def newest(documents: DataFrame, *columns: Column | str) -> DataFrame:
    """(node, generated_at, columns): one row a run, from its newest file. The columns are cut out before anything moves."""
    rows = documents.select(node().alias("run_node"), "generated_at", F.struct("file_time", "file_path").alias("file"), F.struct(*columns).alias("own"))
    return rows.groupBy(F.col("run_node").alias("node"), "generated_at").agg(F.max_by("own", "file").alias("own")).select(*RUN, "own.*")


def latest(documents: DataFrame, *columns: Column | str) -> DataFrame:
    """As newest, of each node's last run only."""
    rows = newest(documents, *columns)
    return rows.groupBy("node").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "node"]), "generated_at").alias("own")).select("node", "own.*")


def results(documents: DataFrame) -> DataFrame:
    """Nine rows a run: ordinal, capability, status, severity, evidence, reason, recommendation; a capability that a report leaves out has no row."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(n).alias("capability"), *[F.col(f"capabilities.{n}.{f}").alias(f) for f in ("status", "severity", "evidence", "reason", "recommendation")]) for i, n in enumerate(CAPABILITIES)])
    return newest(documents, "capabilities").select(*RUN, F.inline(rows)).filter("status IS NOT NULL")


def blocked(documents: DataFrame) -> DataFrame:
    """Runs that may not be dispatched: severity, capability, message, recommendation of each blocker."""
    return newest(documents, "experiment_blockers").select(*RUN, F.posexplode("experiment_blockers").alias("position", "b")).select(*RUN, "position", "b.severity", "b.capability", "b.message", "b.recommendation")


def dispatchable(documents: DataFrame) -> DataFrame:
    """Runs without a blocker."""
    return newest(documents, F.size("experiment_blockers").alias("n")).filter("n = 0").select(*RUN)


def telemetry_plan(documents: DataFrame) -> DataFrame:
    """Energy domains to sample, in order, where RAPL can be read."""
    rows = newest(documents, F.col("backends.telemetry.cpu_rapl").alias("cpu_rapl"), F.col("backends.energy_domains").alias("domains"))
    return rows.filter("cpu_rapl").select(*RUN, F.posexplode("domains").alias("position", "domain"))


def degraded(documents: DataFrame) -> DataFrame:
    """Degraded capabilities and why."""
    return results(documents).filter("status = 'degraded'").select(*RUN, "capability", "reason")


def leaves(column: Column, kind: DataType, path: str) -> list[tuple[str, Column]]:
    """(path, value as text) of every leaf of a column; arrays and maps are leaves, as JSON."""
    if isinstance(kind, StructType):
        return [leaf for f in kind for leaf in leaves(column[f.name], f.dataType, f"{path}.{f.name}")]
    return [(path, column.cast("string") if kind.simpleString() not in ("binary",) and not kind.simpleString().startswith(("array", "map")) else F.to_json(column))]


def compare_reports(documents: DataFrame, sections: list[str], node_column: str = "node") -> DataFrame:
    """(node, path, value, majority_value) of every leaf in which a node differs from most nodes; documents have a row a node.

    Sections are hashed whole and nodes grouped by hash, so a section's leaves are opened once for each different content and
    counted with the number of its nodes. A leaf's majority value is the commonest, the least of equal ones; an absent value is `<null>`.
    """
    c = F.col
    # Sections keep names of their own, whatever they are called.
    own = {s: f"s_{s}" for s in sections}
    one = [F.struct(F.lit(s).alias("section"), F.sha2(F.coalesce(F.to_json(F.struct(s)), F.lit("")), 256).alias("hash"), *[(c(x) if x == s else F.lit(None).cast(documents.schema[x].dataType)).alias(own[x]) for x in sections]) for s in sections]
    opened = documents.select(c(node_column).alias("of"), F.inline(F.array(*one)))
    variants = opened.groupBy("section", "hash").agg(F.count("*").alias("n"), *[F.first(x, ignorenulls=True).alias(x) for x in own.values()])
    every = {s: F.array(*[F.struct(F.lit(p).alias("path"), F.coalesce(v, F.lit("<null>")).alias("value")) for p, v in leaves(c(own[s]), documents.schema[s].dataType, s)]) for s in sections}
    found = F.lit(None).cast("array<struct<path:string,value:string>>")
    for s in sections:
        found = F.when(c("section") == s, every[s]).otherwise(found)
    values = variants.select("section", "hash", "n", F.inline(found))
    most = values.groupBy("path", "value").agg(F.sum("n").alias("n")).groupBy("path").agg(F.min(F.struct((-c("n")).alias("n"), "value")).alias("most"))
    # One row a path. The sizes of all else are underestimated by Spark, as inline makes rows: those joins must not become broadcasts.
    odd = values.join(F.broadcast(most), "path").filter(c("value") != c("most.value")).select("section", "hash", "path", "value", c("most.value").alias("majority_value"))
    return opened.select("of", "section", "hash").hint("merge").join(odd, ["section", "hash"]).select(c("of").alias("node"), "path", "value", "majority_value")
