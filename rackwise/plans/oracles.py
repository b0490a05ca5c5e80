"""DuckDB SQL for the fleet queries: written from the rules, apart from the Spark code."""

from __future__ import annotations

from rackwise.sources.fixtures import RAPL_DOMAINS, with_views

AT = "strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at"
GEN = "strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at"

SAY = lambda c: f"coalesce(CAST({c} AS VARCHAR), '?')"
LEVEL = "coalesce(CAST(perf_paranoid AS VARCHAR), 'None')"
DRIVER = f"concat('driver ', {SAY('cpufreq_driver')}, ', control model ', {SAY('control_model')})"
#: capability: rungs of (condition, status/severity, evidence, reason, recommendation), texts as SQL.
LADDERS: dict[str, list[tuple[str, ...]]] = {
    "cpu_discovery": [
        ("logical_cpus > 0", "available/info", f"concat({SAY('logical_cpus')}, ' logical CPUs, ', {SAY('physical_cores')}, ' cores, ', {SAY('sockets')}, ' sockets')", "NULL", "NULL"),
        ("true", "unavailable/critical", "'no CPU count was found'", "'lscpu gave no usable output'", "'install util-linux or check /proc'"),
    ],
    "cpu_telemetry": [
        ("perf_accessible AND freq_success", "available/info", f"concat('perf works at level ', {LEVEL}, '; ', {SAY('current_khz')}, ' kHz now')", "NULL", "NULL"),
        ("perf_accessible", "degraded/warning", "'perf works; the current frequency can''t be read'", "'no numeric scaling_cur_freq'", "'load a cpufreq driver'"),
        ("tool_perf", "unavailable/critical", f"concat('perf is installed but failed at level ', {LEVEL})", "coalesce(perf_note, 'perf stat failed')", "'lower kernel.perf_event_paranoid or run as root'"),
        ("true", "unavailable/critical", "'perf is not installed'", "'perf is not in PATH'", "'install the kernel''s perf tools'"),
    ],
    "energy_cpu": [
        ("rapl_readable AND rapl_probe_success", "available/info", f"concat({SAY('domain_tested')}, ' read ', {SAY('sample_value_uj')}, ' uJ; ', CAST(n_domains AS VARCHAR), ' domains')", "NULL", "NULL"),
        ("rapl_readable", "degraded/warning", "concat(CAST(n_domains AS VARCHAR), ' domains may be read but no reading succeeded')", "'the counter gave no number'", "'read energy_uj twice and compare'"),
        ("rapl_available", "unavailable/critical", "concat(CAST(n_domains AS VARCHAR), ' domains exist but can''t be read')", "'no read permission on energy_uj'", "'grant read access or run as root'"),
        ("true", "unavailable/critical", "'no RAPL domain exists'", "'powercap has no intel-rapl entry'", "'load the RAPL driver or use another meter'"),
    ],
    "cpu_control": [
        ("cpufreq_writable AND limits <> ''", "degraded/warning", f"concat('the governor can be written; ', {DRIVER})", "limits", "'treat set frequencies as bounds'"),
        ("cpufreq_writable", "available/info", f"concat('the governor can be written; ', {DRIVER}, ', method ', {SAY('scaling_method')})", "NULL", "NULL"),
        ("coalesce(cpufreq_driver, '') <> ''", "unavailable/warning", "concat('driver ', cpufreq_driver, ' is loaded but its governor can''t be written')", "'no write permission on the governor'", "'run as root or grant write access'"),
        ("true", "unavailable/warning", "'no cpufreq driver is loaded'", "'cpufreq is absent'", "'load a cpufreq driver'"),
    ],
    "gpu_discovery": [
        ("gpu_present", "available/info", f"concat({SAY('device_count')}, ' GPUs: ', {SAY('nvidia_count')}, ' NVIDIA, ', {SAY('intel_count')}, ' Intel')", "NULL", "NULL"),
        ("true", "unavailable/critical", "'no GPU was found'", "'neither nvidia-smi nor lspci lists one'", "'check drivers and slots'"),
    ],
    "gpu_telemetry": [
        ("gpu_observable AND gpu_metrics_success", "available/info", f"concat({SAY('temperature_c')}, ' C, ', {SAY('power_draw_w')}, ' W')", "NULL", "NULL"),
        ("gpu_observable", "degraded/warning", "'nvidia-smi exists but gave no metrics'", "'the metrics query failed'", "'check the driver'"),
        ("gpu_present", "unavailable/warning", "'a GPU exists without nvidia-smi'", "'nvidia-smi is missing'", "'install the vendor''s tools'"),
        ("true", "unavailable/critical", "'no GPU to measure'", "'no GPU was found'", "'add a GPU'"),
    ],
    "gpu_control": [
        ("gpu_controllable", "available/info", "'nvidia-smi lists clocks that can be set'", "NULL", "NULL"),
        ("gpu_observable", "unavailable/warning", "'GPU clocks can''t be set'", "coalesce(gpu_reason, 'no clock control')", "'use a device that lists clocks'"),
        ("gpu_present", "unavailable/warning", "'a GPU exists but can''t be controlled'", "coalesce(gpu_reason, 'nvidia-smi is missing')", "'install the vendor''s tools'"),
        ("true", "unavailable/critical", "'no GPU to control'", "'no GPU was found'", "'add a GPU'"),
    ],
    "topology_awareness": [
        ("numa_nodes > 0 AND tool_numactl", "available/info", "concat(CAST(numa_nodes AS VARCHAR), ' NUMA nodes; numactl can pin')", "NULL", "NULL"),
        ("numa_nodes > 0", "degraded/warning", "concat(CAST(numa_nodes AS VARCHAR), ' NUMA nodes; numactl is missing')", "'numactl is not in PATH'", "'install numactl'"),
        ("true", "unavailable/info", "'no NUMA topology'", "'one memory node or none shown'", "'nothing is needed on one-node machines'"),
    ],
}
NAMES = (*LADDERS, "full_pipeline")
LIMITS = "CASE WHEN hwp THEN concat('hardware chooses its own P-state within the range; requests are hints', CASE WHEN epp THEN '' ELSE '; no energy-performance preference can be set' END) WHEN pstate_status = 'passive' THEN 'intel_pstate is passive and takes frequency ranges as acpi-cpufreq does' WHEN pstate_status = 'off' THEN 'intel_pstate is off; another driver is in use' ELSE '' END"
#: What the ladders read, from the flat runs.
RUN_INPUTS = f"""ins AS (SELECT *, cores_per_socket * sockets AS physical_cores, {LIMITS} AS limits, CASE WHEN cpufreq_driver = 'acpi-cpufreq' THEN 'discrete' WHEN pstate_status = 'active' THEN 'hwp_range' WHEN pstate_status = 'passive' THEN 'pstate_range' ELSE 'unknown' END AS control_model,
  CASE WHEN cpufreq_driver = 'acpi-cpufreq' THEN 'discrete' WHEN cpufreq_driver <> '' THEN 'range' ELSE 'unknown' END AS scaling_method, gpu_present AND tool_nvidia_smi AS gpu_observable, gpu_present AND tool_nvidia_smi AND nvidia_present AND gpu_clocks_ok AS gpu_controllable,
  CASE WHEN rapl_available THEN 1 ELSE 0 END AS n_domains, NULL AS current_khz, NULL AS perf_note, NULL AS domain_tested, NULL AS sample_value_uj, NULL AS device_count, NULL AS nvidia_count, NULL AS intel_count, NULL AS temperature_c, NULL AS power_draw_w, NULL AS gpu_reason
  FROM (SELECT *, pstate_status = 'active' AS hwp, epp_available AS epp FROM fleet_runs))"""


def ladders() -> str:
    """CTEs w (one row a run, c0 to c8 as status/severity) and r (nine rows a run) over the CTE ins."""
    case = lambda rungs, k, text: "CASE " + " ".join(f"WHEN {x[0]} THEN " + (f"'{x[k]}'" if text else x[k]) for x in rungs) + " END"
    states = ", ".join(f"{case(rungs, 1, True)} AS c{i}" for i, rungs in enumerate(LADDERS.values()))
    missing = lambda of: "concat_ws(', ', " + ", ".join(f"CASE WHEN c{i} NOT LIKE 'available%' THEN '{NAMES[i]}' END" for i in of) + ")"
    telemetry = " AND ".join(f"c{i} LIKE 'available%'" for i in (0, 1, 2, 4, 5))
    rows = [f"SELECT *, {i + 1} AS ordinal, '{name}' AS capability, c{i} AS c, " + ", ".join(f"{case(rungs, k, False)} AS {n}" for k, n in ((2, "evidence"), (3, "reason"), (4, "recommendation"))) + " FROM w" for i, (name, rungs) in enumerate(LADDERS.items())]
    rows.append(
        f"SELECT *, 9, 'full_pipeline', c8, CASE WHEN c8 = 'available/info' THEN 'all telemetry and control is available' WHEN c8 = 'degraded/warning' THEN concat('telemetry is complete; control is missing: ', {missing((3, 6))}) ELSE concat('telemetry is incomplete: ', {missing((0, 1, 2, 4, 5))}) END, "
        "CASE c8 WHEN 'degraded/warning' THEN 'control is incomplete' WHEN 'unavailable/critical' THEN 'telemetry is incomplete' END, CASE c8 WHEN 'degraded/warning' THEN 'resolve the control capabilities' WHEN 'unavailable/critical' THEN 'resolve the telemetry capabilities' END FROM w"
    )
    return (
        f"v AS (SELECT *, {states} FROM ins), w AS (SELECT *, CASE WHEN {telemetry} AND c3 LIKE 'available%' AND c6 LIKE 'available%' THEN 'available/info' WHEN {telemetry} THEN 'degraded/warning' ELSE 'unavailable/critical' END AS c8 FROM v), "
        f"u AS ({' UNION ALL '.join(rows)}), r AS (SELECT *, split_part(c, '/', 1) AS status, split_part(c, '/', 2) AS severity FROM u)"
    )


def _runs(sql: str) -> str:
    return f"{with_views('fleet_runs')}, {RUN_INPUTS}, {ladders()} {sql}"


def _captures(sql: str) -> str:
    return f"{with_views('captures')}, {ONCE}, {SHARED} {sql}"


def _assessed(sql: str) -> str:
    return f"{with_views('captures')}, {ONCE}, {SHARED}, {CAPTURE_INPUTS}, {ladders()} {sql}"


BLOCKED = "severity = 'critical' AND status <> 'available'"
ONCE = "once AS (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY node_id, captured_at, source, item ORDER BY received_at DESC, rc DESC, content DESC, stderr DESC) = 1)"
#: Parts that several oracles use.
SHARED = """lscpu AS (SELECT node_id, captured_at, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS a FROM once WHERE source = 'lscpu' AND rc = 0)),
kv AS (SELECT node_id, captured_at, trim(split_part(line, ':', 1)) AS key, arg_max(trim(substr(line, strpos(line, ':') + 1)), i) AS value FROM lscpu WHERE contains(line, ':') GROUP BY ALL),
runs AS (SELECT DISTINCT node_id, captured_at FROM once),
tools AS (SELECT node_id, captured_at, coalesce(bool_or(rc = 0) FILTER (item = 'perf'), false) AS tool_perf, coalesce(bool_or(rc = 0) FILTER (item = 'cpupower'), false) AS tool_cpupower, coalesce(bool_or(rc = 0) FILTER (item = 'numactl'), false) AS tool_numactl, coalesce(bool_or(rc = 0) FILTER (item = 'nvidia_smi'), false) AS tool_nvidia_smi FROM once WHERE source = 'which' GROUP BY ALL),
smi AS (SELECT node_id, captured_at, string_split(line, ',') AS f FROM (SELECT node_id, captured_at, unnest(string_split(content, chr(10))) AS line FROM once WHERE source = 'nvidia_gpus' AND rc = 0 AND content <> '') WHERE len(string_split(line, ',')) = 5),
pci AS (SELECT node_id, captured_at, CASE WHEN lower(line) LIKE '%nvidia%' AND NOT EXISTS (SELECT 1 FROM smi s WHERE s.node_id = x.node_id AND s.captured_at = x.captured_at) THEN 'nvidia' WHEN lower(line) LIKE '%intel%' THEN 'intel' END AS vendor, split_part(line, ' ', 1) AS bus_id,
  trim(CASE WHEN len(string_split(line, ':')) >= 3 THEN array_to_string(string_split(line, ':')[3:], ':') ELSE string_split(line, ':')[-1] END) AS name
  FROM (SELECT node_id, captured_at, unnest(string_split(content, chr(10))) AS line FROM once WHERE source = 'lspci' AND rc = 0 AND content <> '') x WHERE lower(line) LIKE '%vga%' OR lower(line) LIKE '%3d%' OR lower(line) LIKE '%display%'),
gpu AS (SELECT node_id, captured_at, 'nvidia' AS vendor, 'nvidia-smi' AS origin, trim(f[2]) AS name, '' AS bus_id, trim(f[1]) AS index_raw FROM smi UNION ALL SELECT node_id, captured_at, vendor, 'lspci', name, bus_id, '' FROM pci WHERE vendor IS NOT NULL),
counts AS (SELECT node_id, captured_at, count(vendor) AS device_count, count(*) FILTER (vendor = 'nvidia') AS nvidia_count, count(*) FILTER (vendor = 'intel') AS intel_count FROM runs LEFT JOIN gpu USING (node_id, captured_at) GROUP BY ALL),
freq AS (SELECT node_id, captured_at, max(content) FILTER (item = 'scaling_driver') AS driver, max(content) FILTER (item = 'scaling_governor') AS governor, max(content) FILTER (item = 'scaling_available_governors') AS governors, max(content) FILTER (item = 'cpuinfo_min_freq') AS mn, max(content) FILTER (item = 'cpuinfo_max_freq') AS mx, max(content) FILTER (item = 'base_frequency') AS base, max(content) FILTER (item = 'scaling_available_frequencies') AS steps, max(content) FILTER (item = 'scaling_cur_freq') AS cur FROM once WHERE source = 'sysfs_cpufreq' GROUP BY ALL),
pstate AS (SELECT node_id, captured_at, max(content) FILTER (item = 'status') AS status, bool_or(item = 'hwp_dynamic_boost') OR max(content) FILTER (item = 'status') = 'active' AS hwp, bool_or(item = 'energy_performance_preference') AS epp FROM once WHERE source = 'sysfs_pstate' GROUP BY ALL),
rapl AS (SELECT node_id, captured_at, string_agg(CASE WHEN content <> '' THEN item || ' (' || content || ')' ELSE item END, '|' ORDER BY item) AS domains FROM once WHERE source = 'powercap_name' GROUP BY ALL),
energy AS (SELECT node_id, captured_at, bool_or(rc = 0) AS readable, arg_min(content, item) FILTER (rc = 0 AND regexp_full_match(content, '[0-9]+')) AS sample, min(item) FILTER (rc = 0 AND regexp_full_match(content, '[0-9]+')) AS tested FROM once WHERE source = 'powercap_energy' GROUP BY ALL),
access AS (SELECT node_id, captured_at, coalesce(bool_or(rc = 0) FILTER (item = 'scaling_governor_w'), false) AS writable, coalesce(bool_or(rc = 0) FILTER (item = 'is_root'), false) AS root FROM once WHERE source = 'access' GROUP BY ALL),
topo AS (SELECT node_id, captured_at, coalesce(max(value) FILTER (key = 'Vendor ID'), 'unknown') AS vendor, coalesce(max(value) FILTER (key = 'Model name'), 'unknown') AS model_name, coalesce(nullif(max(TRY_CAST(value AS INT)) FILTER (key = 'CPU(s)'), 0), max(TRY_CAST(o.content AS INT)), 0) AS logical_cpus, coalesce(max(TRY_CAST(value AS INT)) FILTER (key = 'Socket(s)'), 0) AS sockets, coalesce(max(TRY_CAST(value AS INT)) FILTER (key = 'Thread(s) per core'), 0) AS threads_per_core, coalesce(max(TRY_CAST(value AS INT)) FILTER (key = 'Core(s) per socket'), 0) AS cores FROM runs LEFT JOIN kv USING (node_id, captured_at) LEFT JOIN (SELECT node_id, captured_at, content FROM once WHERE source = 'os_cpu_count' AND rc = 0) o USING (node_id, captured_at) GROUP BY ALL),
clocks AS (SELECT node_id, captured_at, item, rc, content FROM once WHERE source = 'nvidia_clocks'),
mhz AS (SELECT DISTINCT node_id, captured_at, item, 'memory' AS kind, CAST(unnest(regexp_extract_all(content, 'Memory\\s*:\\s*(\\d+)\\s*MHz', 1)) AS INT) AS mhz FROM clocks WHERE rc = 0 UNION ALL SELECT DISTINCT node_id, captured_at, item, 'graphics', CAST(unnest(regexp_extract_all(content, 'Graphics\\s*:\\s*(\\d+)\\s*MHz', 1)) AS INT) FROM clocks WHERE rc = 0),
gputax AS (SELECT c.node_id, c.captured_at, nvidia_count > 0 AS nvidia, device_count > 0 AS present, device_count > 0 AND tool_nvidia_smi AS observable, device_count > 0 AND tool_nvidia_smi AND nvidia_count > 0 AND coalesce((SELECT bool_or(rc = 0 AND content <> '') AND NOT bool_or(contains(content, 'N/A')) FROM clocks k WHERE k.node_id = c.node_id AND k.captured_at = c.captured_at), false) AS controllable FROM counts c JOIN tools USING (node_id, captured_at)),
nline AS (SELECT node_id, captured_at, regexp_extract(trim(line), '^node\\s+(\\d+)\\s+cpus:\\s+(.+)$', 1) AS numa_id, regexp_extract(trim(line), '^node\\s+(\\d+)\\s+cpus:\\s+(.+)$', 2) AS list, 'numactl' AS origin FROM (SELECT node_id, captured_at, unnest(string_split(content, chr(10))) AS line FROM once WHERE source = 'numactl' AND rc = 0) WHERE regexp_matches(trim(line), '^node\\s+(\\d+)\\s+cpus:\\s+.')),
numa AS (SELECT * FROM nline UNION ALL SELECT node_id, captured_at, replace(item, 'node', ''), content, 'sysfs' FROM once c WHERE source = 'sysfs_cpulist' AND trim(content) <> '' AND NOT EXISTS (SELECT 1 FROM nline n WHERE n.node_id = c.node_id AND n.captured_at = c.captured_at)),
perf AS (SELECT t.node_id, t.captured_at, TRY_CAST(p.content AS INT) AS level, coalesce(tool_perf AND s.rc = 0, false) AS accessible, CASE WHEN NOT tool_perf THEN 'perf is not installed' WHEN s.rc = 0 AND TRY_CAST(p.content AS INT) >= 2 THEN concat('perf works; level ', p.content, ' keeps kernel profiling from users') WHEN s.rc = 0 THEN 'perf works without restriction' ELSE concat('perf stat returned ', coalesce(CAST(s.rc AS VARCHAR), 'nothing'), ': ', coalesce(nullif(s.stderr, ''), 'unknown error'), CASE WHEN TRY_CAST(p.content AS INT) >= 3 THEN concat('; level ', p.content, ' shuts out all but root') ELSE '' END) END AS note FROM tools t LEFT JOIN (SELECT * FROM once WHERE source = 'procfs') p USING (node_id, captured_at) LEFT JOIN (SELECT * FROM once WHERE source = 'perf_stat') s USING (node_id, captured_at)),
metrics AS (SELECT c.node_id, c.captured_at, split_part(content, chr(10), 1) AS line, rc = 0 AND coalesce(tool_nvidia_smi, false) AND EXISTS (SELECT 1 FROM smi s WHERE s.node_id = c.node_id AND s.captured_at = c.captured_at) AND contains(split_part(content, chr(10), 1), ',') AS ok FROM once c LEFT JOIN tools USING (node_id, captured_at) WHERE source = 'nvidia_metrics')"""
#: What the ladders read, from the captures.
CAPTURE_INPUTS = f"""ins AS (SELECT *, {LIMITS} AS limits FROM (SELECT t.node_id, t.captured_at, logical_cpus, t.cores * t.sockets AS physical_cores, t.sockets, t.vendor, t.model_name, coalesce(tool_perf, false) AS tool_perf, coalesce(tool_numactl, false) AS tool_numactl, p.level AS perf_paranoid, coalesce(accessible, false) AS perf_accessible, p.note AS perf_note,
  coalesce(regexp_full_match(cur, '[0-9]+'), false) AS freq_success, CASE WHEN regexp_full_match(cur, '[0-9]+') THEN cur WHEN driver IS NOT NULL THEN '' END AS current_khz, domains IS NOT NULL AS rapl_available, coalesce(readable, false) AS rapl_readable, CASE WHEN domains IS NULL THEN 0 ELSE len(string_split(domains, '|')) END AS n_domains, domains,
  tested IS NOT NULL AS rapl_probe_success, tested AS domain_tested, sample AS sample_value_uj, driver AS cpufreq_driver, coalesce(writable, false) AS cpufreq_writable, coalesce(hwp, false) AS hwp, coalesce(epp, false) AS epp, s.status AS pstate_status,
  CASE WHEN steps <> '' THEN 'discrete' WHEN base <> '' OR (mn <> '' AND mx <> '') THEN 'range' WHEN driver IS NOT NULL THEN 'unknown' END AS scaling_method, CASE WHEN driver IS NULL THEN NULL WHEN steps <> '' THEN 'discrete' WHEN hwp THEN 'hwp_range' WHEN s.status = 'passive' THEN 'pstate_range' ELSE 'unknown' END AS control_model,
  present AS gpu_present, observable AS gpu_observable, controllable AS gpu_controllable, CASE WHEN controllable THEN NULL WHEN observable AND NOT nvidia THEN 'only NVIDIA clocks can be set and there is no NVIDIA device' WHEN observable THEN 'nvidia-smi lists no clocks' WHEN present THEN 'nvidia-smi is missing' ELSE 'no GPU was found' END AS gpu_reason,
  device_count, nvidia_count, intel_count, coalesce(ok, false) AS gpu_metrics_success, CASE WHEN ok THEN trim(split_part(line, ',', 1)) WHEN line IS NOT NULL THEN '' END AS temperature_c, CASE WHEN ok THEN trim(split_part(line, ',', 2)) WHEN line IS NOT NULL THEN '' END AS power_draw_w,
  (SELECT count(*) FROM numa n WHERE n.node_id = t.node_id AND n.captured_at = t.captured_at) AS numa_nodes, (SELECT content FROM once c WHERE c.node_id = t.node_id AND c.captured_at = t.captured_at AND c.source = 'uname' AND c.item = 'hostname') AS hostname
  FROM topo t LEFT JOIN tools USING (node_id, captured_at) LEFT JOIN perf p USING (node_id, captured_at) LEFT JOIN access USING (node_id, captured_at) LEFT JOIN counts USING (node_id, captured_at) LEFT JOIN gputax USING (node_id, captured_at) LEFT JOIN freq USING (node_id, captured_at) LEFT JOIN pstate s USING (node_id, captured_at) LEFT JOIN rapl USING (node_id, captured_at) LEFT JOIN energy USING (node_id, captured_at) LEFT JOIN metrics USING (node_id, captured_at)))"""
CHUNK = "CASE WHEN contains(k, '-') THEN TRY_CAST(trim(split_part(k, '-', 1)) AS INT) ELSE TRY_CAST(trim(k) AS INT) END AS lo, CASE WHEN contains(k, '-') THEN TRY_CAST(trim(substr(k, strpos(k, '-') + 1)) AS INT) ELSE TRY_CAST(trim(k) AS INT) END AS hi"
ENERGY = with_views("energy_samples") + ", s AS (SELECT *, energy_uj - lag(energy_uj) OVER (PARTITION BY node_id, domain ORDER BY ts, sample_id) AS d FROM energy_samples), w AS (SELECT *, (CASE WHEN d < 0 THEN d + 400000000 ELSE d END) / 1e6 AS j FROM s) "
INTERVALS = with_views("energy_samples", "experiments") + ", s AS (SELECT *, energy_uj - lag(energy_uj) OVER (PARTITION BY node_id, domain ORDER BY ts, sample_id) AS d FROM energy_samples), w AS (SELECT *, (CASE WHEN d < 0 THEN d + 400000000 ELSE d END) / 1e6 AS j FROM s) "
IN_RUN = with_views("energy_samples", "experiments") + ", s AS (SELECT e.*, run_no, energy_uj - lag(energy_uj) OVER (PARTITION BY e.node_id, run_no, domain ORDER BY ts, sample_id) AS d FROM energy_samples e JOIN experiments x ON x.node_id = e.node_id AND ts BETWEEN begin_at AND end_at), j AS (SELECT *, (CASE WHEN d < 0 THEN d + 400000000 ELSE d END) / 1e6 AS j FROM s) "
SECTIONS = {
    "cpu": ("logical_cpus", "sockets", "cores_per_socket", "cpufreq_driver", "pstate_status", "cpufreq_writable", "epp_available"), "rapl": ("rapl_available", "rapl_readable", "rapl_probe_success"), "gpu": ("nvidia_present", "gpu_present", "gpu_metrics_success", "gpu_clocks_ok"),
    "tools": ("tool_perf", "tool_nvidia_smi", "tool_numactl"), "probes": ("perf_accessible", "perf_paranoid", "freq_success", "numa_nodes"),
}
RUNS_NEWEST = (
    f"{with_views('fleet_runs')}, {RUN_INPUTS.replace('FROM fleet_runs)', 'FROM fleet_runs QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY generated_at DESC) = 1)')}, {ladders()}, a AS ("
    + " UNION ALL ".join([f"SELECT node_id, 'capabilities.' || capability || '.{f}' AS path, coalesce({f}, '<null>') AS value FROM r" for f in ("status", "severity", "evidence", "reason", "recommendation")] + [f"SELECT node_id, '{k}.{c}', coalesce(CAST({c} AS VARCHAR), '<null>') FROM w" for k, names in SECTIONS.items() for c in names])
    + "), m AS (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, value) = 1 AS first FROM a GROUP BY path, value) "
)
COMPARED = ("logical_cpus", "sockets", "cpufreq_driver", "pstate_status", "perf_paranoid", "numa_nodes")
VALUES = with_views("fleet_runs") + ", newest AS (SELECT * FROM fleet_runs QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY generated_at DESC) = 1), a AS (" + " UNION ALL ".join(f"SELECT node_id, '{c}' AS attribute, coalesce(CAST({c} AS VARCHAR), '<null>') AS value FROM newest" for c in COMPARED) + "), n AS (SELECT attribute, value, count(*) AS n_nodes FROM a GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n_nodes DESC, value) = 1 AS majority FROM n) "


def oracle_sql() -> dict[str, str]:
    key = f"node_id, {AT}"
    run = f"node_id, {GEN}"
    flags = ", ".join(f"bool_or(status = 'available') FILTER (capability = '{c}') AS {c}_ready" for c in NAMES if c != "topology_awareness")
    levels = " UNION ALL ".join(f"SELECT '{d}' AS domain, '{v}' AS level" for d, v in RAPL_DOMAINS)
    nodes = {
        "capability_texts": f"SELECT {run}, ordinal, capability, status, severity, evidence, reason, recommendation FROM r",
        "cap_status_long": f"SELECT {run}, ordinal, capability, status, severity FROM r",
        "experiment_blockers": f"SELECT {run}, ordinal, capability, severity, evidence AS message, recommendation FROM r WHERE {BLOCKED}",
        "issues_ranked": f"SELECT {run}, row_number() OVER (PARTITION BY node_id, generated_at ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, ordinal) AS position, capability, severity FROM r WHERE status <> 'available'",
        "readiness_flags": f"SELECT node_id, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at, {flags} FROM r GROUP BY 1, 2",
        "telemetry_backends": f"SELECT {run}, c1 LIKE 'available%' AS cpu_perf, c2 NOT LIKE 'unavailable%' AS cpu_rapl, c5 LIKE 'available%' AS gpu_nvml FROM w",
        "control_backends": f"SELECT {run}, c3 NOT LIKE 'unavailable%' AS cpu_cpufreq, c6 LIKE 'available%' AS gpu_clocks FROM w",
        "dispatchable_nodes": f"SELECT {run} FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.node_id = w.node_id AND r.generated_at = w.generated_at AND {BLOCKED})",
        "blocked_nodes": f"SELECT {run}, capability, evidence AS message, recommendation FROM r WHERE {BLOCKED}",
        "degraded_capabilities": f"SELECT {run}, capability, reason FROM r WHERE status = 'degraded'",
        "readiness_rollup": "SELECT rack_id, capability, CAST(grouping(rack_id, capability) AS INT) AS level, count(*) AS n, count(*) FILTER (status = 'available') AS n_available, round(count(*) FILTER (status = 'available') / count(*), 6) AS rate FROM r GROUP BY ROLLUP (rack_id, capability)",
        "stream_gate": f"SELECT {run}, ordinal, capability, evidence AS message FROM r WHERE {BLOCKED}",
    }
    captures = {
        "kv_facts": f"SELECT {key}, key, value FROM kv",
        "cpu_list_rows": f"SELECT {key}, item, CAST(row_number() OVER (PARTITION BY node_id, captured_at, item ORDER BY i, cpu) - 1 AS INT) AS position, CAST(cpu AS INT) AS cpu FROM (SELECT *, unnest(CASE WHEN lo <= hi THEN generate_series(lo, hi) ELSE [] END) AS cpu FROM (SELECT *, {CHUNK} FROM (SELECT node_id, captured_at, item, unnest(string_split(content, ',')) AS k, unnest(range(1, len(string_split(content, ',')) + 1)) AS i FROM once WHERE source = 'sysfs_cpulist')))",
        "supported_clocks": f"SELECT {key}, item AS index_raw, kind, CAST(row_number() OVER (PARTITION BY node_id, captured_at, item, kind ORDER BY mhz) - 1 AS INT) AS position, mhz FROM mhz",
        "nvidia_devices": f"SELECT s.node_id, strftime(s.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, trim(f[1]) AS index_raw, TRY_CAST(trim(f[1]) AS INT) AS index, trim(f[2]) AS name, trim(f[3]) AS driver_version, trim(f[4]) AS vbios_version, trim(f[5]) AS memory_total_mb, coalesce((SELECT string_agg(CAST(mhz AS VARCHAR), ',' ORDER BY mhz) FROM mhz m WHERE m.node_id = s.node_id AND m.captured_at = s.captured_at AND m.item = trim(s.f[1]) AND kind = 'memory'), '') AS memory_clocks, coalesce((SELECT string_agg(CAST(mhz AS VARCHAR), ',' ORDER BY mhz) FROM mhz m WHERE m.node_id = s.node_id AND m.captured_at = s.captured_at AND m.item = trim(s.f[1]) AND kind = 'graphics'), '') AS graphics_clocks FROM smi s",
        "pci_display_adapters": f"SELECT {key}, vendor, bus_id, name FROM pci WHERE vendor IS NOT NULL",
        "numa_topology": f"SELECT {key}, numa_id, origin, CAST(cpu AS INT) AS cpu FROM (SELECT *, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS cpu FROM (SELECT node_id, captured_at, numa_id, origin, flatten(list(CASE WHEN lo <= hi THEN generate_series(lo, hi) ELSE [] END)) AS c FROM (SELECT *, {CHUNK} FROM (SELECT *, unnest(string_split(list, ',')) AS k FROM numa)) GROUP BY ALL))",
        "gpu_metrics": f"SELECT {key}, ok AS success, CASE WHEN ok THEN trim(split_part(line, ',', 1)) ELSE '' END AS temperature_c, CASE WHEN ok THEN trim(split_part(line, ',', 2)) ELSE '' END AS power_draw_w FROM metrics",
        "sysfs_pivot": f"SELECT {key}, driver, governor AS governor_current, regexp_replace(governors, '\\s+', ' ', 'g') AS governors, mn AS min_khz, mx AS max_khz, base AS base_frequency_khz, steps FROM freq",
        "tool_presence": f"SELECT {key}, tool_perf, tool_cpupower, tool_numactl, tool_nvidia_smi FROM tools",
        "perf_probe": f"SELECT {key}, level AS event_paranoid_level, accessible, note FROM perf",
        "freq_probe": f"SELECT {key}, regexp_full_match(cur, '[0-9]+') AS success, CASE WHEN regexp_full_match(cur, '[0-9]+') THEN cur ELSE '' END AS current_khz FROM freq",
        "node_identity": "SELECT node_id, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, max(content) FILTER (item = 'hostname') AS hostname, max(content) FILTER (item = 'os') AS os, max(content) FILTER (item = 'kernel') AS kernel, max(content) FILTER (item = 'architecture') AS architecture FROM once WHERE source = 'uname' GROUP BY 1, 2",
        "ok_captures": f"SELECT {key}, source, item FROM once WHERE rc = 0 AND content <> ''",
        "rapl_probe": f"SELECT {key}, true AS success, tested AS domain_tested, sample AS sample_value_uj FROM energy WHERE tested IS NOT NULL",
        "pstate_facts": f"SELECT {key}, status AS intel_pstate_status, hwp AS hwp_enabled, epp AS epp_available, CASE WHEN hwp THEN 'hwp_range' WHEN status = 'passive' THEN 'pstate_range' ELSE 'unknown' END AS control_model, CAST(CASE WHEN hwp THEN CASE WHEN epp THEN 1 ELSE 2 END WHEN status IN ('passive', 'off') THEN 1 ELSE 0 END AS INT) AS n_limitations FROM pstate",
        "scaling_method": f"SELECT {key}, CASE WHEN steps <> '' THEN 'discrete' WHEN base <> '' OR (mn <> '' AND mx <> '') THEN 'range' ELSE 'unknown' END AS scaling_method, CASE WHEN steps <> '' THEN 'discrete' WHEN hwp THEN 'hwp_range' WHEN status = 'passive' THEN 'pstate_range' ELSE 'unknown' END AS control_model FROM freq LEFT JOIN pstate USING (node_id, captured_at)",
        "rapl_domains": f"SELECT {key}, domains, true AS available, coalesce(readable, false) AS readable FROM rapl LEFT JOIN energy USING (node_id, captured_at)",
        "cpu_topology": f"SELECT {key}, vendor, model_name, logical_cpus, sockets, threads_per_core, cores * sockets AS physical_cores FROM topo",
        "cpu_taxonomy": f"SELECT {key}, logical_cpus > 0 AS present, logical_cpus > 0 AND coalesce(readable, false) AS observable, logical_cpus > 0 AND coalesce(readable, false) AND writable AS controllable, CASE WHEN logical_cpus = 0 THEN 'no CPUs were found' WHEN NOT coalesce(readable, false) THEN 'energy counters cannot be read' WHEN NOT writable THEN 'governor cannot be written' END AS reason FROM topo JOIN access USING (node_id, captured_at) LEFT JOIN energy USING (node_id, captured_at)",
        "gpu_devices": f"SELECT {key}, vendor, origin, name, bus_id, index_raw FROM gpu",
        "gpu_counts": f"SELECT {key}, device_count, nvidia_count, intel_count, nvidia_count > 0 AS nvidia_present FROM counts",
        "gpu_taxonomy": f"SELECT {key}, present, observable, controllable, CASE WHEN controllable THEN NULL WHEN observable AND NOT nvidia THEN 'only NVIDIA clocks can be set and there is no NVIDIA device' WHEN observable THEN 'nvidia-smi lists no clocks' WHEN present THEN 'nvidia-smi is missing' ELSE 'no GPU was found' END AS reason FROM gputax",
        "permissions": f"SELECT {key}, root AS is_root, coalesce(readable, false) AS rapl_readable, writable AS cpufreq_writable, controllable AS gpu_clock_control_available FROM access JOIN gputax USING (node_id, captured_at) LEFT JOIN energy USING (node_id, captured_at)",
        "assemble_reports": f"SELECT t.node_id, strftime(t.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, (SELECT content FROM once c WHERE c.node_id = t.node_id AND c.captured_at = t.captured_at AND c.source = 'uname' AND c.item = 'hostname') AS hostname, logical_cpus, cores * sockets AS physical_cores, tool_perf, accessible AS perf_accessible, coalesce(regexp_full_match(cur, '[0-9]+'), false) AS freq_success, domains IS NOT NULL AS rapl_available, coalesce(readable, false) AS rapl_readable, driver AS cpufreq_driver, writable AS cpufreq_writable, device_count, CAST((SELECT count(*) FROM numa n WHERE n.node_id = t.node_id AND n.captured_at = t.captured_at) AS INT) AS numa_nodes FROM topo t JOIN tools USING (node_id, captured_at) JOIN perf USING (node_id, captured_at) JOIN access USING (node_id, captured_at) JOIN counts USING (node_id, captured_at) LEFT JOIN freq USING (node_id, captured_at) LEFT JOIN rapl USING (node_id, captured_at) LEFT JOIN energy USING (node_id, captured_at)",
        "observable_frequencies": f"SELECT r.node_id, strftime(r.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, CASE WHEN steps <> '' THEN 'discrete' WHEN base <> '' OR (mn <> '' AND mx <> '') THEN 'range' ELSE 'unknown' END AS method, coalesce(mn, '') AS min_khz, coalesce(mx, '') AS max_khz, coalesce(base, '') AS base_frequency_khz, coalesce(steps, '') AS discrete_steps FROM runs r LEFT JOIN freq USING (node_id, captured_at)",
        "energy_domains": f"SELECT {key}, CAST(row_number() OVER (PARTITION BY node_id, captured_at ORDER BY item) - 1 AS INT) AS position, CASE WHEN content <> '' THEN item || ' (' || content || ')' ELSE item END AS domain FROM once WHERE source = 'powercap_name'",
        "telemetry_plan": f"SELECT {key}, CAST(row_number() OVER (PARTITION BY node_id, captured_at ORDER BY item) - 1 AS INT) AS position, CASE WHEN content <> '' THEN item || ' (' || content || ')' ELSE item END AS domain FROM once WHERE source = 'powercap_name' AND EXISTS (SELECT 1 FROM energy e WHERE e.node_id = once.node_id AND e.captured_at = once.captured_at AND readable)",
    }
    node = f"CAST(node_id AS VARCHAR) AS node, {AT.replace('AS captured_at', 'AS generated_at')}"
    position = "CAST(row_number() OVER (PARTITION BY node_id, captured_at ORDER BY ordinal) - 1 AS INT) AS position"
    summary = "count(*) FILTER (severity = 'critical' AND status <> 'available') AS n_blockers, count(*) FILTER (status <> 'available') AS n_issues"
    assessed = {
        "captured_capabilities": f"SELECT {key}, ordinal, capability, status, severity, evidence, reason, recommendation FROM r",
        "fleet_summary": f"SELECT {key}, any_value(hostname) AS hostname, any_value(vendor) AS vendor, any_value(model_name) AS model_name, any_value(device_count) AS device_count, any_value(nvidia_count) AS nvidia_count, any_value(intel_count) AS intel_count, bool_or(rapl_available) AS rapl_available, {summary}, {flags} FROM r GROUP BY node_id, captured_at",
        "report_round_trip": f"SELECT node_id, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS generated_at, any_value(hostname) AS hostname, any_value(logical_cpus) AS logical_cpus, any_value(device_count) AS n_devices, any_value(numa_nodes) AS n_numa, {summary}, " + ", ".join(f"max(status) FILTER (capability = '{c}') AS {c}" for c in NAMES) + " FROM r GROUP BY node_id, captured_at",
        "report_blocked": f"SELECT {node}, {position}, severity, capability, evidence AS message, recommendation FROM r WHERE {BLOCKED}",
        "report_dispatchable": f"SELECT {node} FROM r GROUP BY node_id, captured_at HAVING count(*) FILTER ({BLOCKED}) = 0",
        "report_telemetry_plan": f"SELECT {node}, CAST(unnest(range(n_domains)) AS INT) AS position, unnest(string_split(domains, '|')) AS domain FROM w WHERE rapl_readable",
        "report_degraded": f"SELECT {node}, capability, reason FROM r WHERE status = 'degraded'",
        "report_latest_gate": f"SELECT {node}, count(*) FILTER ({BLOCKED}) AS n_blockers FROM r GROUP BY node_id, captured_at QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY captured_at DESC) = 1",
        "stream_report_gate": f"SELECT {node}, capability, evidence AS message, recommendation FROM r WHERE {BLOCKED}",
        "report_quarantine": "SELECT 'not a report in JSON' AS reason, count(*) AS n, CAST(300 * count(*) AS BIGINT) AS kept FROM topo WHERE node_id % 25 = 0 UNION ALL SELECT 'no node', count(*), 0 FROM topo WHERE node_id % 30 = 1 UNION ALL SELECT 'no time', count(*), 0 FROM topo WHERE node_id % 30 = 2",
    }
    runs = _runs("").strip()
    others = {
        "compare_nodes": VALUES + "SELECT attribute, value, n_nodes, majority FROM m",
        "outlier_nodes": VALUES + "SELECT a.attribute, node_id, a.value, m.value AS majority_value FROM a JOIN m ON a.attribute = m.attribute AND majority WHERE a.value <> m.value",
        "latest_report": f"{with_views('fleet_runs')} SELECT {run}, run_no FROM fleet_runs WHERE run_no = 3",
        "permission_gap": f"{runs} SELECT u.node_id, u.capability, u.status AS user_status, o.status AS root_status FROM r u JOIN r o ON u.node_id = o.node_id AND u.capability = o.capability WHERE u.run_no = 2 AND o.run_no = 3 AND o.status = 'available' AND u.status <> 'available'",
        "status_transitions": f"{runs}, t AS (SELECT *, lag(status) OVER (PARTITION BY node_id, capability ORDER BY generated_at) AS before FROM r) SELECT {run}, capability, before, status FROM t WHERE before <> status",
        "energy_joules": ENERGY + "SELECT node_id, domain, sample_id, round(d / 1e6, 6) AS joules FROM s",
        "energy_joules_wrap": ENERGY + "SELECT node_id, domain, sample_id, round(j, 6) AS joules FROM w",
        "read_captures": with_views("captures") + f" SELECT {key}, source, item, rc, trim(content) AS content, stderr, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM captures",
        "stream_captures": with_views("captures") + f" SELECT DISTINCT {key}, source, item, rc, content FROM captures WHERE rc >= 0",
        "stream_energy": ENERGY + "SELECT node_id, domain, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, round(sum(coalesce(j, 0)), 6) AS joules, count(*) AS n, CAST(0 AS BIGINT) AS late FROM w GROUP BY node_id, domain, date_trunc('hour', ts)",
        "interval_joules": INTERVALS + "SELECT x.node_id, run_no, domain, round((SELECT sum(coalesce(j, 0)) FROM w s WHERE s.node_id = x.node_id AND s.domain = d.domain AND ts <= end_at) - (SELECT sum(coalesce(j, 0)) FROM w s WHERE s.node_id = x.node_id AND s.domain = d.domain AND ts <= begin_at), 4) AS joules FROM experiments x JOIN (SELECT DISTINCT node_id, domain FROM energy_samples) d USING (node_id)",
        "run_energy": IN_RUN + "SELECT node_id, run_no, domain, round(sum(coalesce(j, 0)), 4) AS joules, count(*) AS n FROM j GROUP BY ALL",
        "edp": IN_RUN + f", l AS ({levels}) SELECT node_id, run_no, round(sum(j), 4) AS joules, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS seconds, round(sum(coalesce(j, 0)) * (date_diff('microsecond', min(ts), max(ts)) / 1e6), 0) AS edp FROM (SELECT * REPLACE (coalesce(j, 0) AS j) FROM j) JOIN l USING (domain) WHERE level = 'package' GROUP BY ALL",
        "read_capture_files": with_views("raw_files") + f" SELECT {key}, source, item, CAST(CASE WHEN bool_or(kind = 'rc') THEN coalesce(TRY_CAST(max(body) FILTER (kind = 'rc') AS INT), -1) ELSE 0 END AS INT) AS rc, coalesce(trim(max(body) FILTER (kind = 'out')), '') AS content, coalesce(trim(max(body) FILTER (kind = 'err')), '') AS stderr FROM raw_files GROUP BY ALL",
        "compare_reports": RUNS_NEWEST + "SELECT node_id AS node, a.path, a.value, m.value AS majority_value FROM a JOIN m ON m.path = a.path AND m.first WHERE a.value <> m.value",
        "energy_by_domain_level": ENERGY + f", l AS ({levels}) SELECT node_id, level, round(sum(j), 4) AS joules, count(j) AS intervals FROM w JOIN l USING (domain) GROUP BY ALL",
    }
    return {k: _runs(v) for k, v in nodes.items()} | {k: _assessed(v) for k, v in assessed.items()} | {k: _captures(v) for k, v in captures.items()} | others
