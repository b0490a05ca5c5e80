"""Reports and captures at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.functions.text import strip
from rackwise.operators import outcomes
from rackwise.operators.assess import CAPABILITIES
from rackwise.operators.outcomes import FLAGS

CAP = "STRUCT<status: STRING, severity: STRING, evidence: STRING, reason: STRING, recommendation: STRING>"
TAX = "STRUCT<present: BOOLEAN, observable: BOOLEAN, controllable: BOOLEAN, reason: STRING>"
ISSUE = "STRUCT<severity: STRING, capability: STRING, message: STRING, reason: STRING, recommendation: STRING>"
DEVICE = "STRUCT<index: INT, name: STRING, vendor: STRING, driver_version: STRING, vbios_version: STRING, memory_total_mb: STRING, supported_graphics_clocks_mhz: ARRAY<STRING>, supported_memory_clocks_mhz: ARRAY<STRING>, bus_id: STRING, origin: STRING>"
#: Explicit schema of a report; nothing is inferred, and names that a document has beside these are passed over.
REPORT = f"""schema_version STRING, tool_version STRING, generated_at TIMESTAMP, node_id BIGINT,
node STRUCT<hostname: STRING, os: STRING, kernel: STRING, architecture: STRING>,
cpu STRUCT<vendor: STRING, model_name: STRING, logical_cpus: INT, physical_cores: INT, threads_per_core: INT, sockets: INT,
  cpufreq: STRUCT<driver: STRING, governor_current: STRING, governors_available: ARRAY<STRING>, min_khz: STRING, max_khz: STRING, base_frequency_khz: STRING, available_frequencies_khz: ARRAY<STRING>,
    scaling_method: STRING, intel_pstate_status: STRING, hwp_enabled: BOOLEAN, epp_available: BOOLEAN, control_model: STRING, driver_limitations: ARRAY<STRING>>,
  rapl: STRUCT<available: BOOLEAN, domains: ARRAY<STRING>, readable: BOOLEAN, probe: STRUCT<success: BOOLEAN, sample_value_uj: STRING, domain_tested: STRING>>, taxonomy: {TAX}>,
gpu STRUCT<nvidia_present: BOOLEAN, device_count: BIGINT, devices: ARRAY<{DEVICE}>, by_vendor: STRUCT<nvidia: ARRAY<{DEVICE}>, intel: ARRAY<{DEVICE}>>, taxonomy: {TAX}>,
numa STRUCT<available: BOOLEAN, nodes: MAP<STRING, ARRAY<INT>>>,
tools STRUCT<perf: BOOLEAN, cpupower: BOOLEAN, numactl: BOOLEAN, nvidia_smi: BOOLEAN>,
permissions STRUCT<is_root: BOOLEAN, rapl_readable: BOOLEAN, cpufreq_writable: BOOLEAN, gpu_clock_control_available: BOOLEAN, perf_event_paranoid: INT>,
active_probes STRUCT<perf: STRUCT<event_paranoid_level: INT, accessible: BOOLEAN, tested_with: STRING, note: STRING>, rapl_read: STRUCT<success: BOOLEAN, sample_value_uj: STRING, domain_tested: STRING>,
  cpu_frequency: STRUCT<success: BOOLEAN, current_khz: STRING>, gpu_metrics: STRUCT<success: BOOLEAN, temperature_c: STRING, power_draw_w: STRING>>,
capabilities STRUCT<{", ".join(f"{c}: {CAP}" for c in CAPABILITIES)}>,
backends STRUCT<telemetry: STRUCT<cpu_perf: BOOLEAN, cpu_rapl: BOOLEAN, gpu_nvml: BOOLEAN>, control: STRUCT<cpu_cpufreq: BOOLEAN, gpu_clocks: BOOLEAN>,
  observable_frequencies: STRUCT<method: STRING, min_khz: STRING, max_khz: STRING, base_frequency_khz: STRING, discrete_steps: ARRAY<STRING>>, energy_domains: ARRAY<STRING>>,
experiment_blockers ARRAY<STRUCT<severity: STRING, capability: STRING, message: STRING, recommendation: STRING>>,
readiness STRUCT<{", ".join(f"{c}_ready: BOOLEAN" for c in FLAGS)}, issues: ARRAY<{ISSUE}>>, corrupt STRING"""


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Report documents under path, with their file: one (or an array of them) a file, however it is indented; with `lines` one a line,
    as write_reports writes them. A document that can't be parsed is kept in `corrupt`."""
    rows = spark.read.schema(REPORT).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", True).json(path)
    return _with_file(rows)


def stream_reports(spark: SparkSession, path: str, lines: bool = False, files: int = 1000) -> DataFrame:
    """A directory of report documents as a stream, read as read_reports does; `files` at most in one batch."""
    rows = spark.readStream.schema(REPORT).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).json(path)
    return _with_file(rows)


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))


#: One file a capture and kind: .../node/time/source/item.kind, or those as folders with their names, as Spark writes them.
LAYOUT = r"(?:node_id=)?([^/]+)/(?:captured_at=)?([^/]+)/(?:source=)?([^/]+)/(?:item=)?([^/]+)[/.](?:kind=)?(out|err|rc)(?:/[^/]*)?$"


def read_capture_files(spark: SparkSession, path: str, layout: str = LAYOUT, packed: str | None = None) -> DataFrame:
    """Captures from a tree of raw files: node_id, captured_at, source, item from each file's path, rc, content and stderr from its kinds.

    Names of folders may be percent-encoded; `-` and the name that Spark gives an empty value stand for no item. Bytes that aren't UTF-8 become replacement
    characters; texts lose white space at their ends. Without a file of its kind the content is empty and rc is 0; an rc that is no
    number is -1. Spark passes over empty files and those whose names begin with `_` or a full stop, so a capture without output
    needs its rc. Files elsewhere in the tree are passed over. Several files of one kind count as the newest; received_at is its time.

    A file costs the file system many times what its few bytes cost Spark, so a fleet's files come packed: `packed` is a folder of Parquet with a row
    a file as binaryFile gives them (path, modificationTime, content; see pack_files). Single and packed files of one capture count together.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(*FILE)
    return captures_of_files(files.unionByName(spark.read.parquet(packed).select(*FILE)) if packed else files, layout)


#: What is known of a raw file, whether it lies in a tree or was packed.
FILE = ("path", "modificationTime", "content")


def pack_files(files: DataFrame, path: str) -> None:
    """Raw files (path, modificationTime, content), read from a tree by binaryFile or taken from elsewhere, as rows of few large files."""
    files.select(*FILE).write.parquet(path)


def captures_of_files(files: DataFrame, layout: str = LAYOUT) -> DataFrame:
    """Captures of raw files (path, modificationTime, content), as read_capture_files says."""
    c = F.col
    # Spark escapes what a folder's name can't hold; a path names that escape as it is.
    part = lambda i: F.try_url_decode(F.replace(F.regexp_extract("path", layout, i), F.lit("+"), F.lit("%2B")))
    body = F.coalesce(strip(F.make_valid_utf8(c("content").cast("string"))), F.lit(""))
    item = F.when(part(4).isin("-", "__HIVE_DEFAULT_PARTITION__"), "").otherwise(part(4))
    rows = files.filter(c("path").rlike(layout)).select(part(1).try_cast("long").alias("node_id"), part(2).try_cast("timestamp").alias("captured_at"), part(3).alias("source"), item.alias("item"), part(5).alias("kind"), body.alias("body"), c("modificationTime").alias("at"))
    of = lambda kind: F.max_by(F.when(c("kind") == kind, c("body")), F.when(c("kind") == kind, F.struct("at", "body")))
    found = rows.groupBy("node_id", "captured_at", "source", "item").agg(of("out").alias("content"), of("err").alias("stderr"), of("rc").alias("rc"), F.max("at").alias("received_at"))
    rc = F.when(c("rc").isNull(), 0).otherwise(F.coalesce(c("rc").try_cast("int"), F.lit(-1)))
    return found.select("node_id", "captured_at", "source", "item", rc.alias("rc"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("stderr", F.lit("")).alias("stderr"), "received_at")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Recorded results; contents without white space at the ends, unreadable ones empty."""
    rows = spark.read.parquet(path)
    return rows.withColumn("content", F.coalesce(strip(F.col("content")), F.lit(""))).withColumn("stderr", F.coalesce("stderr", F.lit("")))


def report_documents(assessed: DataFrame) -> DataFrame:
    """Assessed facts of captures (assemble_facts) as whole report documents: a projection."""
    c = F.col
    clocks = lambda text: F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")
    device = lambda d: F.struct(*[d[n].alias(n) for n in ("index", "name", "vendor", "driver_version", "vbios_version", "memory_total_mb")], clocks(d["graphics_clocks"]).alias("supported_graphics_clocks_mhz"), clocks(d["memory_clocks"]).alias("supported_memory_clocks_mhz"), d["bus_id"].alias("bus_id"), d["origin"].alias("origin"))
    # A NUMA id named twice keeps its last list: maps have no equal keys.
    numa = F.filter("numa", lambda x, i: ~F.exists(F.slice("numa", i + 2, F.size("numa")), lambda y: y["numa_id"] == x["numa_id"]))
    assessed = assessed.withColumn("blockers", outcomes.blocker_array()).withColumn("issues", outcomes.issue_array()).withColumn("devices", F.transform("devices", device))
    assessed = assessed.withColumn("numa_map", F.map_from_entries(F.transform(numa, lambda x: F.struct(x["numa_id"], x["cpus"])))).withColumns({f"{n}_ready": F.coalesce(c(f"cap_{n}.status") == "available", F.lit(False)) for n in FLAGS})
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    of_vendor = lambda v: F.filter("devices", lambda d: d["vendor"] == v)
    status = lambda name, *of: F.col(f"cap_{name}.status").isin(*of)
    s = lambda **fields: F.struct(*[(c(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
    probe = s(success="rapl_probe_success", sample_value_uj="sample_value_uj", domain_tested="domain_tested")
    return assessed.select(
        F.lit("2.0.0").alias("schema_version"), F.lit("2.0.0").alias("tool_version"), c("captured_at").alias("generated_at"), "node_id", s(hostname="hostname", os="os", kernel="kernel", architecture="architecture").alias("node"),
        s(
            vendor="vendor", model_name="model_name", logical_cpus="logical_cpus", physical_cores="physical_cores", threads_per_core="threads_per_core", sockets="sockets",
            cpufreq=s(
                driver="cpufreq_driver", governor_current="governor_current", governors_available="governors_available", min_khz="min_khz", max_khz="max_khz", base_frequency_khz="base_frequency_khz", available_frequencies_khz="available_frequencies_khz", scaling_method="scaling_method",
                intel_pstate_status="pstate_status", hwp_enabled="hwp_enabled", epp_available="epp_available", control_model="control_model", driver_limitations="driver_limitations",
            ),
            rapl=s(available="rapl_available", domains="domains", readable="rapl_readable", probe=probe), taxonomy="cpu_taxonomy",
        ).alias("cpu"),
        s(nvidia_present="nvidia_present", device_count="device_count", devices="devices", by_vendor=s(nvidia=of_vendor("nvidia"), intel=of_vendor("intel")), taxonomy=s(present="gpu_present", observable="gpu_observable", controllable="gpu_controllable", reason="gpu_reason")).alias("gpu"),
        s(available=c("numa_nodes") > 0, nodes="numa_map").alias("numa"), s(perf="tool_perf", cpupower="tool_cpupower", numactl="tool_numactl", nvidia_smi="tool_nvidia_smi").alias("tools"),
        s(is_root="is_root", rapl_readable="rapl_readable", cpufreq_writable="cpufreq_writable", gpu_clock_control_available="gpu_controllable", perf_event_paranoid="perf_paranoid").alias("permissions"),
        s(
            perf=s(event_paranoid_level="perf_paranoid", accessible="perf_accessible", tested_with=F.lit("perf stat -e cycles -- true"), note="perf_note"), rapl_read=probe,
            cpu_frequency=s(success="freq_success", current_khz="current_khz"), gpu_metrics=s(success="gpu_metrics_success", temperature_c="temperature_c", power_draw_w="power_draw_w"),
        ).alias("active_probes"),
        s(**{n: f"cap_{n}" for n in CAPABILITIES}).alias("capabilities"),
        s(
            telemetry=s(cpu_perf=status("cpu_telemetry", "available"), cpu_rapl=status("energy_cpu", "available", "degraded"), gpu_nvml=status("gpu_telemetry", "available")),
            control=s(cpu_cpufreq=status("cpu_control", "available", "degraded"), gpu_clocks=status("gpu_control", "available")),
            observable_frequencies=s(
                method=F.coalesce("scaling_method", F.lit("unknown")), **{k: F.coalesce(k, F.lit("")) for k in ("min_khz", "max_khz", "base_frequency_khz")}, discrete_steps=none("available_frequencies_khz", "array<string>")
            ),
            energy_domains=none("domains", "array<string>"),
        ).alias("backends"),
        c("blockers").alias("experiment_blockers"),
        s(**{f"{n}_ready": f"{n}_ready" for n in FLAGS}, issues="issues").alias("readiness"),
    )


def write_reports(documents: DataFrame, path: str) -> None:
    """One JSON document a line by report date, compressed; nulls are written."""
    documents.withColumn("report_date", F.to_date("generated_at")).write.partitionBy("report_date").option("ignoreNullFields", False).option("compression", "gzip").json(path)
