"""Many reports together: gates, comparisons, permission gaps, energy, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackwise.operators.assess import A, CAPABILITIES, D, U
from rackwise.operators.outcomes import experiment_blockers


def dispatchable_nodes(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return results.select(*keys).distinct().join(experiment_blockers(results).select(*keys).distinct(), list(keys), "left_anti")


def blocked_nodes(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return experiment_blockers(results).select(*keys, "capability", "message", "recommendation")


def compare_nodes(facts: DataFrame, node: str, attributes: list[str]) -> DataFrame:
    """attribute, value, n_nodes, majority: how many nodes hold each value, and whether it is the commonest (ties: the least)."""
    text = facts.select(node, *[F.coalesce(F.col(a).cast("string"), F.lit("<null>")).alias(a) for a in attributes])
    counts = text.unpivot([node], attributes, "attribute", "value").groupBy("attribute", "value").agg(F.count("*").alias("n_nodes"))
    # An attribute may have as many values as nodes: the commonest is an aggregate, not a sort of one task's rows.
    most = counts.groupBy("attribute").agg(F.min(F.struct((-F.col("n_nodes")).alias("n"), "value")).alias("most"))
    return counts.join(F.broadcast(most), "attribute").select("attribute", "value", "n_nodes", (F.col("most.value") == F.col("value")).alias("majority"))  # one row an attribute


def outlier_nodes(facts: DataFrame, node: str, attributes: list[str]) -> DataFrame:
    """Nodes whose value differs from the attribute's majority value."""
    text = facts.select(node, *[F.coalesce(F.col(a).cast("string"), F.lit("<null>")).alias(a) for a in attributes]).unpivot([node], attributes, "attribute", "value")
    counts = text.groupBy("attribute", "value").agg(F.count("*").alias("n"))
    most = counts.groupBy("attribute").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("most")).select("attribute", F.col("most.value").alias("majority_value"))
    return text.join(F.broadcast(most), "attribute").filter("value <> majority_value")  # one row an attribute


def latest_report(runs: DataFrame, node: str = "node_id", at: str = "generated_at") -> DataFrame:
    """Each node's newest run."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(node).orderBy(F.desc(at)))).filter("_n = 1").drop("_n")


def permission_gap(assessed: DataFrame) -> DataFrame:
    """Capabilities that a node has as root and not as a user: assessed runs with node_id, is_root, generated_at; the latest run of each.

    A run's nine statuses travel as digits of one number, so a node is one row of fixed width in one aggregation, whatever its runs say.
    """
    c = F.col
    digit = lambda n: F.when(c(f"cap_{n}.status") == A, 0).when(c(f"cap_{n}.status") == D, 1).otherwise(2).cast("long")
    statuses = sum((digit(n) * 3**i for i, n in enumerate(CAPABILITIES)), F.lit(0).cast("long"))
    at = F.coalesce(c("generated_at"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    last = lambda who: F.max_by(F.when(who, c("statuses")), F.when(who, c("at")))
    both = assessed.select("node_id", "is_root", at.alias("at"), statuses.alias("statuses")).groupBy("node_id").agg(last(~c("is_root")).alias("user"), last(c("is_root")).alias("root")).filter("user IS NOT NULL AND root IS NOT NULL AND node_id IS NOT NULL")
    status = lambda who, i: F.get(F.array(*map(F.lit, (A, D, U))), F.pmod(F.floor(c(who) / 3**i), F.lit(3)).cast("int"))
    rows = F.array(*[F.struct(F.lit(n).alias("capability"), status("user", i).alias("user_status"), status("root", i).alias("root_status")) for i, n in enumerate(CAPABILITIES)])
    return both.select("node_id", F.inline(rows)).filter((c("root_status") == A) & (c("user_status") != A))


def energy_joules(samples: DataFrame) -> DataFrame:
    """joules since the sample before, by node and domain; null for the first."""
    before = F.lag("energy_uj").over(Window.partitionBy("node_id", "domain").orderBy("ts", "sample_id"))
    return samples.withColumn("joules", (F.col("energy_uj") - before) / 1e6)


def energy_joules_wrap(samples: DataFrame, max_range: int) -> DataFrame:
    """As energy_joules, with the counter's range added where it wrapped."""
    before = F.lag("energy_uj").over(Window.partitionBy("node_id", "domain").orderBy("ts", "sample_id"))
    step = F.col("energy_uj") - before
    return samples.withColumn("joules", F.when(step < 0, step + max_range).otherwise(step) / 1e6)


def energy_by_domain_level(samples: DataFrame, domains: DataFrame, max_range: int) -> DataFrame:
    """Joules by node and level of domain; levels overlap and are not to be added up. domains: a handful of rows."""
    return energy_joules_wrap(samples, max_range).join(F.broadcast(domains), "domain").groupBy("node_id", "level").agg(F.sum("joules").alias("joules"), F.count("joules").alias("intervals"))


def telemetry_plan(backends: DataFrame, domains: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Domains to sample on nodes whose CPU energy can be read."""
    return backends.filter("cpu_rapl").select(*keys).join(domains, list(keys))


def readiness_rollup(results: DataFrame, group: str) -> DataFrame:
    """Runs and available runs by group and capability, with subtotals; level 0 has both, 1 the group, 3 all."""
    out = results.rollup(group, "capability").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("status") == A).alias("n_available"))
    return out.withColumn("rate", F.round(F.col("n_available") / F.col("n"), 6))


def status_transitions(results: DataFrame) -> DataFrame:
    """Changes of a capability's status from one run of a node to the next."""
    w = Window.partitionBy("node_id", "capability").orderBy("generated_at")
    return results.withColumn("before", F.lag("status").over(w)).filter("before <> status")
