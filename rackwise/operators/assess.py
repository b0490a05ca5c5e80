"""Nine capabilities of a run, each by an ordered ladder of which the first rung that holds decides. Projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.operators.facts import control_model, limitations

CAPABILITIES = ("cpu_discovery", "cpu_telemetry", "energy_cpu", "cpu_control", "gpu_discovery", "gpu_telemetry", "gpu_control", "topology_awareness", "full_pipeline")
TELEMETRY = ("cpu_discovery", "cpu_telemetry", "energy_cpu", "gpu_discovery", "gpu_telemetry")
CONTROL = ("cpu_control", "gpu_control")
A, D, U = "available", "degraded", "unavailable"
INFO, WARNING, CRITICAL = "info", "warning", "critical"


def cap(status: str, severity: str, evidence, reason=None, recommendation=None) -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), text(evidence).alias("evidence"), text(reason).alias("reason"), text(recommendation).alias("recommendation"))


def ladder(*rungs: tuple[Column, Column], otherwise: Column) -> Column:
    out = F.when(*rungs[0])
    for condition, value in rungs[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def inputs(facts: DataFrame) -> DataFrame:
    """facts with every column that the ladders read; what is missing is derived or unknown."""
    have = set(facts.columns)
    add = lambda name, value: facts if name in have else facts.withColumn(name, value)
    null = F.lit(None).cast("string")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.coalesce("pstate_status", F.lit(""))
    facts = add("hwp_enabled", status == "active")
    facts = add("driver_limitations", limitations(status, status == "active", flag("epp_available")))
    facts = add("control_model", F.when(F.col("cpufreq_driver") == "acpi-cpufreq", "discrete").otherwise(control_model(status, status == "active")))
    facts = add("scaling_method", F.when(F.col("cpufreq_driver") == "acpi-cpufreq", "discrete").when(F.col("cpufreq_driver") != "", "range").otherwise("unknown"))
    facts = add("physical_cores", F.col("cores_per_socket") * F.col("sockets") if "cores_per_socket" in have else F.lit(0))
    facts = add("gpu_observable", flag("gpu_present") & flag("tool_nvidia_smi"))
    if "gpu_controllable" not in have:
        facts = facts.withColumn("gpu_controllable", F.col("gpu_observable") & flag("nvidia_present") & flag("gpu_clocks_ok"))
    for name in ("current_khz", "domain_tested", "sample_value_uj", "temperature_c", "power_draw_w", "perf_note", "gpu_reason", "device_count", "nvidia_count", "intel_count"):
        facts = add(name, null)
    return facts if "domains" in have else facts.withColumn("domains", F.when(flag("rapl_available"), F.array(F.lit("intel-rapl:0"))).otherwise(F.array().cast("array<string>")))


def assess(facts: DataFrame) -> DataFrame:
    """facts with a struct(status, severity, evidence, reason, recommendation) for each capability."""
    facts = inputs(facts)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    level = F.coalesce(F.col("perf_paranoid").cast("string"), F.lit("None"))
    n_domains = F.coalesce(F.size("domains"), F.lit(0)).cast("string")
    driver = say("driver ", known("cpufreq_driver"), ", control model ", known("control_model"))
    limits = F.coalesce("driver_limitations", F.array().cast("array<string>"))
    # exists() rather than size(): with a lambda Spark makes short methods of this projection; one method of all passes the 8,000 bytes that the JVM compiles.
    c = {
        "cpu_discovery": ladder((F.col("logical_cpus") > 0, cap(A, INFO, say(known("logical_cpus"), " logical CPUs, ", known("physical_cores"), " cores, ", known("sockets"), " sockets"))), otherwise=cap(U, CRITICAL, "no CPU count was found", "lscpu gave no usable output", "install util-linux or check /proc")),
        "cpu_telemetry": ladder(
            (flag("perf_accessible") & flag("freq_success"), cap(A, INFO, say("perf works at level ", level, "; ", known("current_khz"), " kHz now"))),
            (flag("perf_accessible"), cap(D, WARNING, "perf works; the current frequency can't be read", "no numeric scaling_cur_freq", "load a cpufreq driver")),
            (flag("tool_perf"), cap(U, CRITICAL, say("perf is installed but failed at level ", level), F.coalesce("perf_note", F.lit("perf stat failed")), "lower kernel.perf_event_paranoid or run as root")),
            otherwise=cap(U, CRITICAL, "perf is not installed", "perf is not in PATH", "install the kernel's perf tools"),
        ),
        "energy_cpu": ladder(
            (flag("rapl_readable") & flag("rapl_probe_success"), cap(A, INFO, say(known("domain_tested"), " read ", known("sample_value_uj"), " uJ; ", n_domains, " domains"))),
            (flag("rapl_readable"), cap(D, WARNING, say(n_domains, " domains may be read but no reading succeeded"), "the counter gave no number", "read energy_uj twice and compare")),
            (flag("rapl_available"), cap(U, CRITICAL, say(n_domains, " domains exist but can't be read"), "no read permission on energy_uj", "grant read access or run as root")),
            otherwise=cap(U, CRITICAL, "no RAPL domain exists", "powercap has no intel-rapl entry", "load the RAPL driver or use another meter"),
        ),
        "cpu_control": ladder(
            (flag("cpufreq_writable") & F.exists(limits, lambda x: F.lit(True)), cap(D, WARNING, say("the governor can be written; ", driver), F.concat_ws("; ", limits), "treat set frequencies as bounds")),
            (flag("cpufreq_writable"), cap(A, INFO, say("the governor can be written; ", driver, ", method ", known("scaling_method")))),
            (F.coalesce("cpufreq_driver", F.lit("")) != "", cap(U, WARNING, say("driver ", known("cpufreq_driver"), " is loaded but its governor can't be written"), "no write permission on the governor", "run as root or grant write access")),
            otherwise=cap(U, WARNING, "no cpufreq driver is loaded", "cpufreq is absent", "load a cpufreq driver"),
        ),
        "gpu_discovery": ladder((flag("gpu_present"), cap(A, INFO, say(known("device_count"), " GPUs: ", known("nvidia_count"), " NVIDIA, ", known("intel_count"), " Intel"))), otherwise=cap(U, CRITICAL, "no GPU was found", "neither nvidia-smi nor lspci lists one", "check drivers and slots")),
        "gpu_telemetry": ladder(
            (flag("gpu_observable") & flag("gpu_metrics_success"), cap(A, INFO, say(known("temperature_c"), " C, ", known("power_draw_w"), " W"))),
            (flag("gpu_observable"), cap(D, WARNING, "nvidia-smi exists but gave no metrics", "the metrics query failed", "check the driver")),
            (flag("gpu_present"), cap(U, WARNING, "a GPU exists without nvidia-smi", "nvidia-smi is missing", "install the vendor's tools")),
            otherwise=cap(U, CRITICAL, "no GPU to measure", "no GPU was found", "add a GPU"),
        ),
        "gpu_control": ladder(
            (flag("gpu_controllable"), cap(A, INFO, "nvidia-smi lists clocks that can be set")),
            (flag("gpu_observable"), cap(U, WARNING, "GPU clocks can't be set", F.coalesce("gpu_reason", F.lit("no clock control")), "use a device that lists clocks")),
            (flag("gpu_present"), cap(U, WARNING, "a GPU exists but can't be controlled", F.coalesce("gpu_reason", F.lit("nvidia-smi is missing")), "install the vendor's tools")),
            otherwise=cap(U, CRITICAL, "no GPU to control", "no GPU was found", "add a GPU"),
        ),
        "topology_awareness": ladder(
            ((F.col("numa_nodes") > 0) & flag("tool_numactl"), cap(A, INFO, say(known("numa_nodes"), " NUMA nodes; numactl can pin"))),
            (F.col("numa_nodes") > 0, cap(D, WARNING, say(known("numa_nodes"), " NUMA nodes; numactl is missing"), "numactl is not in PATH", "install numactl")),
            otherwise=cap(U, INFO, "no NUMA topology", "one memory node or none shown", "nothing is needed on one-node machines"),
        ),
    }
    out = facts.withColumns({f"cap_{k}": v for k, v in c.items()})
    ready = lambda names: sum((F.col(f"cap_{n}.status") == A).cast("int") for n in names) == len(names)
    missing = lambda names: F.concat_ws(", ", F.filter(F.array(*[F.when(F.col(f"cap_{n}.status") != A, n) for n in names]), lambda x: x.isNotNull()))
    whole = ladder(
        (ready(TELEMETRY + CONTROL), cap(A, INFO, "all telemetry and control is available")),
        (ready(TELEMETRY), cap(D, WARNING, say("telemetry is complete; control is missing: ", missing(CONTROL)), "control is incomplete", "resolve the control capabilities")),
        otherwise=cap(U, CRITICAL, say("telemetry is incomplete: ", missing(TELEMETRY)), "telemetry is incomplete", "resolve the telemetry capabilities"),
    )
    return out.withColumn("cap_full_pipeline", whole)


def capability_array() -> Column:
    """The nine capabilities of an assessed row as structs with ordinal and capability, in order."""
    return F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(n).alias("capability"), *[F.col(f"cap_{n}.{f}").alias(f) for f in ("status", "severity", "evidence", "reason", "recommendation")]) for i, n in enumerate(CAPABILITIES)])


def capability_results(assessed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Nine rows for each run: keys, ordinal, capability, status, severity, evidence, reason, recommendation."""
    return assessed.select(*keys, F.inline(capability_array()))
