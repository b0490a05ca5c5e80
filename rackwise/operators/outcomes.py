"""What follows from capability results: backends, blockers, readiness, issues, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackwise.operators.assess import A, CAPABILITIES, CRITICAL, D, capability_array

FLAGS = tuple(c for c in CAPABILITIES if c != "topology_awareness")


def telemetry_backends(assessed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return assessed.select(*keys, (F.col("cap_cpu_telemetry.status") == A).alias("cpu_perf"), F.col("cap_energy_cpu.status").isin(A, D).alias("cpu_rapl"), (F.col("cap_gpu_telemetry.status") == A).alias("gpu_nvml"))


def control_backends(assessed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return assessed.select(*keys, F.col("cap_cpu_control.status").isin(A, D).alias("cpu_cpufreq"), (F.col("cap_gpu_control.status") == A).alias("gpu_clocks"))


def observable_frequencies(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return facts.select(*keys, F.coalesce("scaling_method", F.lit("unknown")).alias("method"), text("min_khz"), text("max_khz"), text("base_frequency_khz"), F.coalesce("available_frequencies_khz", F.array().cast("array<string>")).alias("discrete_steps"))


def energy_domains(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each domain label, in order."""
    return facts.select(*keys, F.posexplode("domains").alias("position", "domain"))


def experiment_blockers(results: DataFrame) -> DataFrame:
    """Critical results that aren't available; the message is the evidence."""
    return results.filter((F.col("severity") == CRITICAL) & (F.col("status") != A)).withColumn("message", F.col("evidence"))


def readiness_flags(assessed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each run: whether each capability but topology is available in any assessed row of it. Rows move as flags of fixed width."""
    ready = [F.coalesce(F.col(f"cap_{c}.status") == A, F.lit(False)).alias(f"{c}_ready") for c in FLAGS]
    return assessed.select(*keys, *ready).groupBy(*keys).agg(*[F.max(f"{c}_ready").alias(f"{c}_ready") for c in FLAGS])


def issues(results: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Results that aren't available with their position: critical, warning, info, then by ordinal."""
    rank = severity_rank(F.col("severity"))
    return results.filter(F.col("status") != A).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "ordinal")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def blocker_array() -> Column:
    """The blockers of an assessed row, in order: severity, capability, message, recommendation."""
    found = F.filter(capability_array(), lambda x: (x["severity"] == CRITICAL) & (x["status"] != A))
    return F.transform(found, lambda x: F.struct(x["severity"].alias("severity"), x["capability"].alias("capability"), x["evidence"].alias("message"), x["recommendation"].alias("recommendation")))


def issue_array() -> Column:
    """The issues of an assessed row, the gravest first: severity, capability, message, reason, recommendation."""
    found = F.transform(F.filter(capability_array(), lambda x: x["status"] != A), lambda x: F.struct(severity_rank(x["severity"]).alias("rank"), x["ordinal"].alias("ordinal"), x.alias("x")))
    return F.transform(F.array_sort(found), lambda v: F.struct(v["x"]["severity"].alias("severity"), v["x"]["capability"].alias("capability"), v["x"]["evidence"].alias("message"), v["x"]["reason"].alias("reason"), v["x"]["recommendation"].alias("recommendation")))


def fleet_summary(assessed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each run: identity, GPU counts, RAPL flag, numbers of blockers and issues, readiness flags. A projection."""
    ready = [F.coalesce(F.col(f"cap_{c}.status") == A, F.lit(False)).alias(f"{c}_ready") for c in FLAGS]
    return assessed.select(*keys, "hostname", "vendor", "model_name", "device_count", "nvidia_count", "intel_count", "rapl_available", F.size(blocker_array()).alias("n_blockers"), F.size(issue_array()).alias("n_issues"), *ready)
