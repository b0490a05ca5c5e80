"""Fixture views over the driver's tables, one SQL text for Spark and DuckDB. See FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLEET_RUNS = """
SELECT c_custkey AS node_id, r AS run_no,
  CASE r WHEN 0 THEN TIMESTAMP '2026-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2026-01-02 00:00:00'
         WHEN 2 THEN TIMESTAMP '2026-01-03 00:00:00' ELSE TIMESTAMP '2026-01-03 01:00:00' END AS generated_at,
  (r = 3) AS is_root, c_name AS hostname, c_nationkey AS rack_id,
  CASE WHEN k % 29 = 0 THEN 0 ELSE 4 * (1 + k % 8) END AS logical_cpus,
  CASE WHEN k % 11 = 0 THEN 0 ELSE 1 + k % 2 END AS sockets,
  CASE WHEN k % 11 = 0 THEN 0 ELSE 2 * (1 + k % 8) END AS cores_per_socket,
  (k % 7 <> 0) AS tool_perf,
  (k % 7 <> 0 AND (r = 3 OR k % 5 <> 0)) AS perf_accessible,
  CASE WHEN k % 31 = 0 THEN NULL ELSE k % 5 END AS perf_paranoid,
  (k % 6 <> 0) AS freq_success,
  (k % 9 <> 0) AS rapl_available,
  (k % 9 <> 0 AND (r = 3 OR k % 4 <> 0)) AS rapl_readable,
  (k % 9 <> 0 AND (r = 3 OR k % 4 <> 0) AND k % 13 <> 0) AS rapl_probe_success,
  CASE WHEN k % 10 = 0 THEN '' WHEN k % 3 = 0 THEN 'acpi-cpufreq' ELSE 'intel_pstate' END AS cpufreq_driver,
  CASE WHEN k % 10 = 0 OR k % 3 = 0 THEN '' WHEN k % 2 = 0 THEN 'active' WHEN k % 5 = 1 THEN 'passive' ELSE 'off' END AS pstate_status,
  (k % 10 <> 0 AND (r = 3 OR k % 19 >= 5)) AS cpufreq_writable,
  (k % 4 <> 2) AS epp_available,
  (k % 8 >= 3) AS nvidia_present,
  (k % 8 > 0) AS gpu_present,
  (k % 8 >= 2) AS tool_nvidia_smi,
  (k % 8 >= 3 AND k % 17 <> 0) AS gpu_metrics_success,
  (k % 8 >= 3 AND k % 12 <> 3) AS gpu_clocks_ok,
  CASE WHEN k % 14 = 0 THEN 0 ELSE 1 + k % 2 END AS numa_nodes,
  (k % 3 <> 2) AS tool_numactl
FROM (SELECT c_custkey, c_name, c_nationkey, r, c_custkey + 97 * CASE WHEN r > 2 THEN 2 ELSE r END AS k
      FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(r)) AS t
"""

COLLECTED = """
WITH n AS (SELECT node_id, generated_at AS captured_at, hostname, logical_cpus, sockets, tool_perf, perf_accessible, perf_paranoid,
                  freq_success, rapl_available, rapl_readable, rapl_probe_success, cpufreq_driver, pstate_status, cpufreq_writable,
                  epp_available, tool_nvidia_smi, nvidia_present, tool_numactl, is_root, run_no, CAST(node_id AS VARCHAR(20)) AS ns
           FROM fleet_runs WHERE run_no IN (0, 3))
SELECT node_id, captured_at, 'lscpu' AS source, '' AS item, CASE WHEN node_id % 41 = 0 THEN -1 ELSE 0 END AS rc,
  concat('Vendor ID:   GenuineIntel', chr(10), 'Model name:  ', 'X: rev ', ns, chr(10),
         'CPU(s):  ', CASE WHEN logical_cpus = 0 THEN 'N/A' ELSE CAST(logical_cpus AS VARCHAR(9)) END, chr(10),
         'no separator line', chr(10), 'Socket(s): 9', chr(10), 'Socket(s): ', CAST(sockets AS VARCHAR(9)), chr(10),
         'Core(s) per socket: 4', chr(10), 'Thread(s) per core: 2') AS content,
  CASE WHEN node_id % 41 = 0 THEN 'Command timed out after 10s' ELSE '' END AS stderr FROM n
UNION ALL
SELECT node_id, captured_at, 'uname', item, 0,
  CASE item WHEN 'hostname' THEN hostname WHEN 'os' THEN 'Linux' WHEN 'kernel' THEN concat('6.', CAST(node_id % 5 AS VARCHAR(9)), '.0') ELSE 'x86_64' END, ''
  FROM n CROSS JOIN (VALUES ('hostname'), ('os'), ('kernel'), ('architecture')) AS v(item) WHERE (node_id + run_no) % 5 <> 2
UNION ALL
SELECT node_id, captured_at, 'os_cpu_count', '', 0, CAST(8 + node_id % 3 AS VARCHAR(9)), '' FROM n WHERE node_id % 2 = 0
UNION ALL
SELECT node_id, captured_at, 'which', item,
  CASE WHEN (item = 'perf' AND tool_perf) OR (item = 'numactl' AND tool_numactl) OR (item = 'nvidia_smi' AND tool_nvidia_smi) OR (item = 'cpupower' AND node_id % 2 = 0) THEN 0 ELSE 1 END, '', ''
  FROM n CROSS JOIN (VALUES ('perf'), ('cpupower'), ('numactl'), ('nvidia_smi')) AS v(item)
UNION ALL
SELECT node_id, captured_at, 'access', item,
  CASE WHEN (item = 'scaling_governor_w' AND cpufreq_writable) OR (item = 'is_root' AND is_root) THEN 0 ELSE 1 END, '', ''
  FROM n CROSS JOIN (VALUES ('scaling_governor_w'), ('is_root')) AS v(item)
UNION ALL
SELECT node_id, captured_at, 'perf_stat', '', CASE WHEN perf_accessible THEN 0 ELSE 255 END, '',
  CASE WHEN perf_accessible OR node_id % 2 = 0 THEN '' ELSE 'No permission' END FROM n WHERE tool_perf
UNION ALL
SELECT node_id, captured_at, 'procfs', 'perf_event_paranoid', 0, CAST(perf_paranoid AS VARCHAR(9)), '' FROM n WHERE perf_paranoid IS NOT NULL
UNION ALL
SELECT node_id, captured_at, 'sysfs_cpufreq', item, 0,
  CASE item WHEN 'scaling_driver' THEN cpufreq_driver WHEN 'scaling_governor' THEN 'powersave'
    WHEN 'scaling_available_governors' THEN 'performance  powersave'
    WHEN 'scaling_cur_freq' THEN CASE WHEN freq_success THEN CAST(800000 + 1000 * node_id AS VARCHAR(20)) ELSE '<unknown>' END
    WHEN 'cpuinfo_min_freq' THEN CASE WHEN node_id % 15 = 1 THEN '' ELSE '800000' END
    WHEN 'cpuinfo_max_freq' THEN '4200000'
    WHEN 'base_frequency' THEN CASE WHEN cpufreq_driver = 'intel_pstate' AND node_id % 2 = 0 THEN '2400000' ELSE '' END
    ELSE CASE WHEN cpufreq_driver = 'acpi-cpufreq' THEN '3000000 2000000' ELSE '' END END, ''
  FROM n CROSS JOIN (VALUES ('scaling_driver'), ('scaling_governor'), ('scaling_available_governors'), ('scaling_cur_freq'),
    ('cpuinfo_min_freq'), ('cpuinfo_max_freq'), ('base_frequency'), ('scaling_available_frequencies')) AS v(item) WHERE cpufreq_driver <> ''
UNION ALL
SELECT node_id, captured_at, 'sysfs_pstate', item, 0, CASE item WHEN 'status' THEN pstate_status ELSE '1' END, ''
  FROM n CROSS JOIN (VALUES ('status'), ('hwp_dynamic_boost'), ('energy_performance_preference')) AS v(item)
  WHERE pstate_status <> '' AND (item = 'status' OR (item = 'hwp_dynamic_boost' AND node_id % 7 = 1) OR (item = 'energy_performance_preference' AND epp_available))
UNION ALL
SELECT node_id, captured_at, 'powercap_name', item, 0, CASE item WHEN 'intel-rapl:0' THEN 'package-0' WHEN 'intel-rapl:0:1' THEN 'dram' ELSE '' END, ''
  FROM n CROSS JOIN (VALUES ('intel-rapl:0'), ('intel-rapl'), ('intel-rapl:0:1')) AS v(item) WHERE rapl_available
UNION ALL
SELECT node_id, captured_at, 'powercap_energy', item, CASE WHEN rapl_readable THEN 0 ELSE 13 END,
  CASE WHEN rapl_probe_success THEN CAST(1000000 + node_id AS VARCHAR(20)) ELSE '' END, ''
  FROM n CROSS JOIN (VALUES ('intel-rapl:0'), ('intel-rapl:0:1')) AS v(item) WHERE rapl_available
UNION ALL
SELECT node_id, captured_at, 'numactl', '', CASE WHEN node_id % 5 = 2 THEN 1 ELSE 0 END,
  concat('available: 2 nodes (0-1)', chr(10), 'node 0 cpus: 0-3', chr(10), 'node 0 size: 64 MB', chr(10),
         CASE WHEN node_id % 7 = 3 THEN '  node 1 cpus: 4,5' WHEN node_id % 7 = 4 THEN 'node 1 cpus:' ELSE 'node 1 cpus: 4 5 6 7' END, chr(10), 'node 2 cpus: '), '' FROM n WHERE tool_numactl
UNION ALL
SELECT node_id, captured_at, 'sysfs_cpulist', item, 0,
  CASE WHEN node_id % 5 = 0 THEN '5-3,x,7' WHEN item = 'node0' THEN '0-2,5,9-12' WHEN node_id % 7 = 2 THEN '' ELSE '4-7, 9 ,-1' END, ''
  FROM n CROSS JOIN (VALUES ('node0'), ('node1')) AS v(item)
UNION ALL
SELECT node_id, captured_at, 'nvidia_clocks', item, CASE WHEN node_id % 9 = 0 THEN 9 ELSE 0 END,
  concat('  Memory  : ', CAST(5000 + 100 * (node_id % 3) AS VARCHAR(9)), ' MHz', chr(10), '    Graphics  : 1755 MHz', chr(10),
         '    Graphics  : 210 MHz', chr(10), '    Graphics  : 1755 MHz', CASE WHEN node_id % 5 < 2 THEN concat(chr(10), '    Video : N/A') ELSE '' END), ''
  FROM n CROSS JOIN (VALUES ('0'), ('1')) AS v(item) WHERE nvidia_present
UNION ALL
SELECT node_id, captured_at, 'nvidia_gpus', '', 0,
  concat('0, GPU-', CAST(node_id % 6 AS VARCHAR(9)), ', 550.1, 95.02, 24564', chr(10), 'malformed,row', chr(10), '1, GPU-B, 550.1, 95.03, 81920'), '' FROM n WHERE nvidia_present
UNION ALL
SELECT node_id, captured_at, 'nvidia_metrics', '', CASE WHEN node_id % 17 = 0 THEN 9 ELSE 0 END, concat(CAST(40 + node_id % 9 AS VARCHAR(9)), ', 30.5', chr(10), '99, 99.9'), '' FROM n WHERE nvidia_present
UNION ALL
SELECT node_id, captured_at, 'lspci', '', 0,
  concat('00:02.0 VGA compatible controller: Intel Corporation UHD', chr(10), '00:1f.3 Audio device: Intel Corporation', chr(10),
         CASE WHEN node_id % 8 >= 3 THEN '01:00.0 3D controller: NVIDIA Corporation X' ELSE '01:00.0 Display controller: AMD' END), '' FROM n
"""

#: Deliveries: each capture, again for some nodes, and for others a stale form of it that came before.
CAPTURES = """
SELECT *, captured_at + INTERVAL 1 MINUTE AS received_at FROM collected
UNION ALL
SELECT *, captured_at + INTERVAL 1 MINUTE FROM collected WHERE node_id % 4 = 0
UNION ALL
SELECT node_id, captured_at, source, item, -1, concat('stale: ', content), 'Command timed out after 10s', captured_at + INTERVAL 30 SECOND FROM collected WHERE node_id % 6 = 1
"""

ENERGY_SAMPLES = """
SELECT node_id, domain, sample_id, ts,
  CAST(SUM(step) OVER (PARTITION BY node_id, domain ORDER BY ts, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 400000000 AS BIGINT) AS energy_uj
FROM (SELECT user_id AS node_id, event_id AS sample_id, ts, CAST(ROUND(value * 100) AS BIGINT) * 10000 AS step,
  CASE event_id % 8 WHEN 0 THEN 'intel-rapl:0:0' WHEN 1 THEN 'intel-rapl:0:1' WHEN 2 THEN 'intel-rapl:1' WHEN 3 THEN 'intel-rapl-mmio' WHEN 4 THEN 'intel-rapl-mmio:0' ELSE 'intel-rapl:0' END AS domain FROM events) AS e
"""

RAPL_DOMAINS = (("intel-rapl:0", "package"), ("intel-rapl:0:0", "core"), ("intel-rapl:0:1", "dram"), ("intel-rapl:1", "package2_or_psys"), ("intel-rapl-mmio", "mmio"), ("intel-rapl-mmio:0", "mmio_package"))

#: Three experiments a node on the days of its energy samples; the second overlaps the first.
EXPERIMENTS = """
SELECT c_custkey AS node_id, r AS run_no, begin_at, begin_at + INTERVAL 5 DAY AS end_at
FROM (SELECT c_custkey, r, TIMESTAMP '2024-01-03 12:00:00' + CASE r WHEN 0 THEN INTERVAL 0 DAY WHEN 1 THEN INTERVAL 3 DAY ELSE INTERVAL 15 DAY END AS begin_at
      FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS v(r)) AS t
"""

#: Raw files of one collection a supplier's machine: kind is the output's, body its text.
RAW_FILES = """
SELECT s_suppkey AS node_id, TIMESTAMP '2026-01-05 00:00:00' AS captured_at, source, item, kind,
  CASE WHEN kind = 'rc' THEN CASE WHEN source = 'lscpu' AND s_suppkey % 5 = 0 THEN 'killed' WHEN source = 'lscpu' THEN '0' ELSE '13' END WHEN kind = 'err' THEN '  denied '
       WHEN source = 'lscpu' THEN concat('CPU(s): ', CAST(4 + s_suppkey % 8 AS VARCHAR(9)), chr(10), 'Socket(s): 1') WHEN source = 'uname' THEN s_name ELSE 'package-0' END AS body
FROM supplier CROSS JOIN (VALUES ('lscpu', '', 'out'), ('lscpu', '', 'rc'), ('uname', 'hostname', 'out'), ('powercap_name', 'intel-rapl:0', 'out'), ('perf_stat', '', 'err'), ('perf_stat', '', 'rc')) AS v(source, item, kind)
WHERE NOT (source = 'uname' AND s_suppkey % 7 = 3)
"""

VIEWS = {"fleet_runs": FLEET_RUNS, "collected": COLLECTED, "captures": CAPTURES, "energy_samples": ENERGY_SAMPLES, "experiments": EXPERIMENTS, "raw_files": RAW_FILES}
NEEDS = {"fleet_runs": (), "captures": ("fleet_runs", "collected"), "energy_samples": (), "experiments": (), "raw_files": ()}


def with_views(*views: str) -> str:
    """WITH clause that defines `views` and what they need."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v].strip()})" for view in views for v in (*NEEDS[view], view))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in sf_dir."""
    source = {"energy_samples": "events", "raw_files": "supplier"}.get(name, "customer")
    sql = f"{with_views(name)} SELECT * FROM {name}".replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def rapl_domain_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RAPL_DOMAINS), "domain string, level string")
