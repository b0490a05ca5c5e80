import json
import os
import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rackwise.functions.text import cpu_list
from rackwise.operators import assess, energy, facts, fleet, from_reports, parse
from rackwise.plans import oracles, queries
from rackwise.sources import reports
from rackwise.streaming import gates

DATA = "/root/testdata/sf0.001"
CAPTURES = "node_id long, captured_at timestamp, source string, item string, rc int, content string, stderr string"


@pytest.mark.parametrize("text, want", [("2-4,9,12-13", [2, 3, 4, 9, 12, 13]), ("0", [0]), ("5-3,x,7", [7]), ("4-7, 9 ,-1", [4, 5, 6, 7, 9]), ("0 1 2 3", []), ("1-2-3", []), ("1,1", [1, 1]), ("", [])])
def test_cpu_list(spark, text, want):
    assert spark.range(1).select(cpu_list(F.lit(text)).alias("c")).first().c == want


def captures(spark, *rows):
    return spark.createDataFrame([(1, None, *r) for r in rows], CAPTURES)


def test_kv_facts_keep_the_last_key_and_split_at_the_first_colon(spark):
    rows = parse.kv_facts(captures(spark, ("lscpu", "", 0, "Vendor ID:  A: B\nnosep\nSocket(s): 9\r\nSocket(s):  2", ""))).collect()
    assert {r.key: r.value for r in rows} == {"Vendor ID": "A: B", "Socket(s)": "2"}
    assert parse.kv_facts(captures(spark, ("lscpu", "", -1, "a: b", ""))).count() == 0


def test_clocks_are_distinct_and_rising(spark):
    rows = parse.supported_clocks(captures(spark, ("nvidia_clocks", "0", 0, " Memory : 7001 MHz\n  Graphics : 1410 MHz\n  Graphics : 1395 MHz\n  Graphics : 1410 MHz", ""))).collect()
    assert sorted((r.kind, r.mhz) for r in rows) == [("graphics", 1395), ("graphics", 1410), ("memory", 7001)]


def test_pci_adapter_names(spark):
    rows = parse.pci_display_adapters(captures(spark, ("lspci", "", 0, "00:02.0 VGA compatible controller: Intel Corporation UHD\n0000:01:00.0 3D controller: NVIDIA X", ""))).collect()
    assert {(r.bus_id, r.vendor, r.name) for r in rows} == {("00:02.0", "intel", "Intel Corporation UHD"), ("0000:01:00.0", "nvidia", "00.0 3D controller: NVIDIA X")}


def test_properties_of_results(spark):
    nodes = queries._view(spark, DATA, "fleet_runs")
    rows = assess.capability_results(assess.assess(nodes), ("node_id", "run_no")).collect()
    assert len(rows) == 9 * nodes.count() and all(r.evidence for r in rows)
    by = {((r.node_id, r.run_no), r.capability): r for r in rows}
    for (node, name), r in by.items():
        if name == "full_pipeline" and r.status == "available":
            assert all(by[node, c].status == "available" for c in assess.TELEMETRY + assess.CONTROL)


def test_numa_nodes_need_a_list(spark):
    shown = ("numactl", "", 0, "available: 2 nodes\n  node 0 cpus: 0-1\nnode 1 cpus:\nnode 2 cpus: ", "")
    assert [(r.numa_id, r.cpus, r.origin) for r in parse.numa_topology(captures(spark, shown)).collect()] == [("0", [0, 1], "numactl")]
    memory_only = captures(spark, ("numactl", "", 0, "node 1 cpus:", ""), ("sysfs_cpulist", "node0", 0, "0-1\n", ""), ("sysfs_cpulist", "node1", 0, "", ""))
    assert [(r.numa_id, r.origin) for r in parse.numa_topology(memory_only).collect()] == [("0", "sysfs")]


def test_cpu_count_of_the_operating_system(spark):
    rows = captures(spark, ("lscpu", "", -1, "", "timed out"), ("os_cpu_count", "", 0, "12", "")).withColumn("captured_at", F.lit("2026-01-01").cast("timestamp"))
    assert facts.cpu_topology(rows).first().logical_cpus == 12


def test_indented_reports_are_read(spark, tmp_path):
    whole = {"schema_version": "2.0.0", "generated_at": "2026-03-06T12:00:00Z", "numa": {"available": True, "nodes": {"0": [0, 1]}}, "gpu": {"devices": [{"index": 0, "vendor": "nvidia"}], "by_vendor": {"nvidia": [], "intel": []}}, "readiness": {"cpu_discovery_ready": True, "issues": [{"severity": "info", "capability": "c", "message": "m"}]}, "unknown": 1}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    got = {r.file_path[-6:]: r for r in reports.read_reports(spark, f"file://{tmp_path}").collect()}
    assert got["a.json"].corrupt is None and got["a.json"].numa.nodes == {"0": [0, 1]} and got["a.json"].readiness.issues[0].message == "m" and got["a.json"].gpu.devices[0].vendor == "nvidia"
    assert got["b.json"].corrupt == "{broken"


def test_reports_hold_every_section(spark, tmp_path):
    seen = queries._view(spark, DATA, "captures")
    reports.write_reports(reports.report_documents(queries._assembled(seen)), f"file://{tmp_path}/r")
    back = reports.read_reports(spark, f"file://{tmp_path}/r", lines=True)
    for r in back.collect():
        assert r.corrupt is None
        statuses = r.capabilities.asDict()
        assert len(r.gpu.devices) == r.gpu.device_count == len(r.gpu.by_vendor.nvidia) + len(r.gpu.by_vendor.intel) and r.numa.available == bool(r.numa.nodes)
        assert len(r.readiness.issues) == sum(c.status != "available" for c in statuses.values()) and r.readiness.full_pipeline_ready == (statuses["full_pipeline"].status == "available")
        assert [b.capability for b in r.experiment_blockers] == [n for n, c in statuses.items() if c.severity == "critical" and c.status != "available"] and r.cpu.taxonomy.present == (r.cpu.logical_cpus > 0)


def test_facts_of_every_run_in_one_shuffle(spark):
    rows = captures(spark, ("lscpu", "", 0, "CPU(s): 4", ""), ("which", "perf", 0, "", ""), ("perf_stat", "", 0, "", "")).withColumn("captured_at", F.lit("2026-01-01").cast("timestamp"))
    rows = rows.unionByName(rows.withColumn("node_id", F.lit(2).cast("long")).filter("source = 'lscpu'")).unionByName(rows.limit(0).unionByName(spark.createDataFrame([(3, None, None, None, None, None, None)], CAPTURES)))
    assembled = facts.assemble_facts(rows)
    got = {r.node_id: r for r in assembled.collect()}
    assert got.keys() == {1, 2, 3} and got[1].hostname is None and got[1].perf_accessible and not got[2].perf_accessible and got[2].logical_cpus == 4 and got[3].logical_cpus == 0
    seen = queries._view(spark, DATA, "captures")
    plan = facts.assemble_facts(seen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("operator", [parse.ok_captures, parse.kv_facts, parse.cpu_list_rows, parse.supported_clocks, parse.nvidia_devices, parse.pci_display_adapters, parse.numa_topology, parse.tool_presence, parse.node_identity, parse.sysfs_pivot, parse.perf_probe, parse.freq_probe, parse.gpu_metrics, parse.rapl_probe, facts.pstate_facts, facts.scaling_method, facts.rapl_domains, facts.cpu_topology, facts.cpu_taxonomy, facts.gpu_devices, facts.gpu_counts, facts.gpu_taxonomy, facts.permissions, facts.assemble_facts], ids=lambda f: f.__name__)
def test_repeated_deliveries_change_nothing(spark, operator):
    seen = queries._view(spark, DATA, "captures").filter("node_id < 30")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(operator(parse.once(seen))) == plain(operator(seen.unionByName(seen)))


def test_the_newest_delivery_counts(spark):
    rows = spark.createDataFrame([(1, "a", 0, "old", "", 1), (1, "a", 0, "new", "", 2), (1, "b", 0, "none", "", None), (1, "b", 0, "some", "", 1), (1, "c", 0, "x", "", 1), (1, "c", 1, "y", "", 1)], "node_id long, item string, rc int, content string, stderr string, t int")
    rows = rows.selectExpr("node_id", "TIMESTAMP '2026-01-01' AS captured_at", "'s' AS source", "item", "rc", "content", "stderr", "timestamp_seconds(t) AS received_at")
    assert sorted((r.item, r.content) for r in parse.once(rows).collect()) == [("a", "new"), ("b", "some"), ("c", "y")]


def test_reports_to_the_fleet(spark, tmp_path):
    caps = {n: {"status": "available", "severity": "info", "evidence": "e", "reason": None, "recommendation": None} for n in assess.CAPABILITIES}
    doc = lambda name, **more: {"generated_at": "2026-03-06T12:00:00Z", "node": {"hostname": name}, "capabilities": {**caps, "_capability_names_": ["x"]}, "experiment_blockers": [], "backends": {"telemetry": {"cpu_rapl": True}, "energy_domains": ["d0", "d1"]}} | more
    blocked = [{"severity": "critical", "capability": "energy_cpu", "message": "m", "recommendation": "r"}]
    worse = {**caps, "cpu_control": {"status": "degraded", "severity": "warning", "evidence": "e", "reason": "hwp", "recommendation": "x"}}
    for k, d in enumerate([doc("a", experiment_blockers=blocked), doc("a"), doc("b", experiment_blockers=blocked, capabilities=worse), doc("c", generated_at="2026-03-05T12:00:00Z", experiment_blockers=blocked), doc("c"), doc(""), doc("e", generated_at=None), doc("f", capabilities=None), doc("g", experiment_blockers=None), doc("h", backends=None)]):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=1))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    (tmp_path / "x.json").write_text('{"generated_at": "2026-')
    read = reports.read_reports(spark, f"file://{tmp_path}")
    assert sorted(r.reason for r in from_reports.quarantined(read).collect()) == ["no backends", "no blockers", "no capabilities", "no node", "no time", "not a report in JSON"]
    good = from_reports.sound(read)
    names = lambda df: sorted(r.node for r in df.collect())
    assert names(from_reports.dispatchable(good)) == ["a", "c"] and names(from_reports.blocked(good)) == ["b", "c"]
    assert [(r.node, r.reason) for r in from_reports.degraded(good).collect()] == [("b", "hwp")]
    assert from_reports.results(good).count() == 4 * 9 and from_reports.telemetry_plan(good).count() == 8
    assert {r.node: r.n for r in from_reports.latest(good, F.size("experiment_blockers").alias("n")).collect()} == {"a": 0, "b": 1, "c": 0}
    # Only the nested fields that a question needs are read from a stored table.
    good.write.parquet(str(tmp_path / "stored"))
    plan = from_reports.telemetry_plan(spark.read.parquet(str(tmp_path / "stored")))._jdf.queryExecution().executedPlan().toString()
    assert "experiment_blockers" not in plan and "evidence" not in plan


def test_report_stream(spark, tmp_path):
    doc = lambda name, n: json.dumps({"generated_at": "2026-03-06T12:00:00Z", "node": {"hostname": name}, "capabilities": {}, "backends": {}, "experiment_blockers": [{"severity": "critical", "capability": f"c{i}"} for i in range(n)]})
    source, out, dead, state = (tmp_path / n for n in ("in", "out", "dead", "state"))
    source.mkdir()

    def gate():
        gates.start_report_gate(reports.stream_reports(spark, f"file://{source}", files=2), f"file://{out}", f"file://{dead}", f"file://{state}").awaitTermination()
        return {r.node: len(r.experiment_blockers) for r in gates.gated(spark, f"file://{out}").collect()}

    for k, text in enumerate([doc("a", 2), doc("b", 1), '{"broken', doc("a", 0)]):
        (source / f"{k}.json").write_text(text)
        os.utime(source / f"{k}.json", (1000 + k, 1000 + k))
    assert gate() == {"a": 0, "b": 1}
    (source / "again.json").write_text(doc("b", 1))
    assert gate() == {"a": 0, "b": 1}
    assert [(r.reason, r.corrupt) for r in spark.read.parquet(f"file://{dead}").collect()] == [("not a report in JSON", '{"broken')]
    assert len(list(out.glob("batch=*"))) >= 3


SAMPLES = "node_id long, domain string, ts timestamp_ntz, sample_id long, energy_uj long"


def test_intervals_of_energy(spark):
    day = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    samples = spark.createDataFrame([(1, "p", day(m), m, (m * 30) % 1000) for m in range(0, 200, 10)] + [(1, "q", day(50), 1, 5), (1, "p", None, 1, 5)], SAMPLES)
    asked = [(1, 1, day(0), day(190)), (1, 2, day(15), day(47)), (1, 3, day(-5), day(30)), (1, 4, day(60), day(50)), (2, 5, day(0), day(9)), (1, 6, day(40), day(40))]
    intervals = spark.createDataFrame(asked, "node_id long, id long, b timestamp_ntz, e timestamp_ntz")
    got = {(r.id, r.domain): r.joules for r in energy.interval_joules(samples, intervals, ["node_id", "id"], "b", "e", 1000).collect()}
    assert got == {(1, "p"): 5700 / 1e6, (1, "q"): None, (2, "p"): 900 / 1e6, (2, "q"): None, (3, "p"): None, (3, "q"): None, (4, "p"): None, (4, "q"): None, (6, "p"): 0.0, (6, "q"): None}


def test_runs_of_a_node_with_many_samples(spark):
    start = datetime(2026, 1, 1)
    samples = spark.range(100_000).selectExpr("CASE WHEN id < 99000 THEN 1 ELSE 2 END AS node_id", "'p' AS domain", "CAST(timestamp_seconds(1767225600 + id) AS TIMESTAMP_NTZ) AS ts", "id AS sample_id", "id * 10 % 1000 AS energy_uj")
    runs = spark.createDataFrame([(1, 1, start, start + timedelta(hours=5)), (1, 2, start + timedelta(hours=4), start + timedelta(hours=30)), (1, 3, start - timedelta(days=9), start - timedelta(days=8)), (2, 4, start, start + timedelta(days=3))], "node_id long, run_no long, begin_at timestamp_ntz, end_at timestamp_ntz")
    dim = spark.createDataFrame([("p", "package"), ("x", "core")], "domain string, level string")
    got = {r.run_no: (round(r.joules, 6), r.seconds) for r in energy.edp(samples, runs, dim, max_range=1000, width=3600).collect()}
    assert got == {1: (0.18, 18000.0), 2: (round((98_999 - 14_400) * 10 / 1e6, 6), 98_999.0 - 14_400), 4: (round(999 * 10 / 1e6, 6), 999.0)}
    plan = energy.run_energy(samples, runs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_of_energy_is_exact_over_batches(spark, tmp_path):
    samples = queries._view(spark, DATA, "energy_samples").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    days = [r.d for r in samples.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for k in range(0, len(days), 10):
        samples.filter(F.to_date("ts").isin(days[k : k + 10])).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    gates.stream_energy(stream, queries.WRAP).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out)
    got = {(r.node_id, r.domain): round(r.j, 6) for r in gates.energy_windows(rows).groupBy("node_id", "domain").agg(F.sum("joules").alias("j")).collect()}
    want = fleet.energy_joules_wrap(samples, queries.WRAP).groupBy("node_id", "domain").agg(F.coalesce(F.sum("joules"), F.lit(0.0)).alias("j")).collect()
    assert got == {(r.node_id, r.domain): round(r.j, 6) for r in want} and rows.agg(F.sum("late")).first()[0] == 0
    # Two samples that come after their time are counted and change no sum.
    late = samples.orderBy("ts").limit(2).withColumn("sample_id", F.lit(-1).cast("long"))
    late.coalesce(1).write.mode("append").parquet(source)
    gates.stream_energy(spark.readStream.schema(samples.schema).parquet(source), queries.WRAP).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    again = gates.energy_windows(spark.read.parquet(out)).agg(F.sum("joules").alias("j"), F.sum("late").alias("late")).first()
    assert again.late == 2 and round(again.j, 4) == round(sum(r.j for r in want), 4)


def test_capture_files(spark, tmp_path):
    files = {"7/2026-01-01T00%3A00%3A00Z/lscpu/-.out": b" CPU(s): 4\n", "7/2026-01-01T00%3A00%3A00Z/lscpu/-.rc": b"0\n", "7/2026-01-01T00%3A00%3A00Z/powercap_name/intel-rapl%3A0.out": b"package-0\xff", "7/2026-01-01T00%3A00%3A00Z/perf_stat/-.err": b"denied", "7/2026-01-01T00%3A00%3A00Z/perf_stat/-.rc": b"255", "7/2026-01-01T00%3A00%3A00Z/numactl/-.out": b"", "7/2026-01-01T00%3A00%3A00Z/numactl/-.rc": b"1", "7/README": b"no capture", "x/2026-01-01/lscpu/-.rc": b"what"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {(r.node_id, r.source, r.item): (r.rc, r.content, r.stderr) for r in reports.read_capture_files(spark, f"file://{tmp_path}").collect()}
    assert got == {(7, "lscpu", ""): (0, "CPU(s): 4", ""), (7, "powercap_name", "intel-rapl:0"): (0, "package-0\ufffd", ""), (7, "perf_stat", ""): (255, "", "denied"), (7, "numactl", ""): (1, "", ""), (None, "lscpu", ""): (-1, "", "")}


def test_packed_capture_files_are_read_as_a_tree_is(spark, tmp_path):
    tree, packed = tmp_path / "tree", f"file://{tmp_path}/packed"
    for name, body in {"7/2026-01-01T00%3A00%3A00Z/lscpu/-.out": b" CPU(s): 4\n", "7/2026-01-01T00%3A00%3A00Z/lscpu/-.rc": b"x", "7/2026-01-01T00%3A00%3A00Z/powercap_name/intel-rapl%3A0.out": b"a+b\xff", "notes.txt": b"no capture"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body)
        os.utime(tree / name, (1000, 1000))
    reports.pack_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{tree}"), packed)
    want = sorted(map(tuple, reports.read_capture_files(spark, f"file://{tree}").collect()))
    (tmp_path / "empty").mkdir()
    assert len(want) == 2 and sorted(map(tuple, reports.read_capture_files(spark, f"file://{tmp_path}/empty", packed=packed).collect())) == want
    # A single file that is newer than the packed ones of its capture.
    newer = tmp_path / "late/7/2026-01-01T00%3A00%3A00Z/lscpu"
    newer.mkdir(parents=True)
    (newer / "-.rc").write_text("5")
    got = {r.source: (r.rc, r.content) for r in reports.read_capture_files(spark, f"file://{tmp_path}/late", packed=packed).collect()}
    assert got == {"lscpu": (5, "CPU(s): 4"), "powercap_name": (0, "a+b\ufffd")}


def test_raw_files_of_a_fleet_are_not_files_each(spark, tmp_path, monkeypatch):
    """A supplier's machine has about six raw files; 100 machines' are packed but for one machine's."""
    monkeypatch.setattr(queries, "_scratch", lambda spark, n=iter(range(99)): f"file://{tmp_path}/{next(n)}")
    monkeypatch.setattr(queries, "_WRITTEN", {})
    got = queries.read_capture_files(spark, "/root/testdata/sf0.01")
    assert got.select("node_id").distinct().count() == 100 and len(list(tmp_path.rglob("part-*"))) < 100


def test_comparison_of_reports(spark):
    rows = [(n, {"x": 1 if n < 4 else 2, "y": {"z": None if n == 5 else "s"}}, [1, 2] if n != 3 else [2, 1]) for n in range(6)]
    docs = spark.createDataFrame(rows, "node long, a struct<x:int,y:struct<z:string>>, b array<int>").withColumn("b", F.struct(F.col("b").alias("l")))
    got = sorted((r.node, r.path, r.value, r.majority_value) for r in from_reports.compare_reports(docs, ["a", "b"]).collect())
    assert got == [(3, "b.l", "[2,1]", "[1,2]"), (4, "a.x", "2", "1"), (5, "a.x", "2", "1"), (5, "a.y.z", "<null>", "s")]


def test_whole_reports_compared_plainly(spark):
    """All sections of real report documents: the paths in which a node differs from the commonest value, by a walk over each document."""
    seen = queries._view(spark, DATA, "captures")
    sections = ["node", "cpu", "gpu", "numa", "tools", "permissions", "active_probes", "capabilities", "backends", "experiment_blockers", "readiness"]
    docs = reports.report_documents(queries._assembled(seen)).filter("generated_at < '2026-01-02'").withColumns({"numa": F.struct("numa"), "experiment_blockers": F.struct("experiment_blockers")})
    got = {(r.node_id, r.path) for r in from_reports.compare_reports(docs.withColumn("node_key", F.col("node_id")), sections, "node_key").withColumnRenamed("node", "node_id").collect()}

    def walk(value, path):
        if isinstance(value, Row):
            for name in value.__fields__:
                yield from walk(value[name], f"{path}.{name}")
        else:
            yield path, value

    leaves = {r.node_id: dict(leaf for s in sections for leaf in walk(r[s], s)) for r in docs.collect()}
    text = lambda v: "<null>" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    for path in next(iter(leaves.values())):
        values = {n: d[path] for n, d in leaves.items()}
        count = Counter(map(str, values.values()))
        top = max(count.values())
        odd = {n for n in values if (n, path) in got}
        # The nodes that aren't named share one value, which is as common as any.
        rest = {str(v) for n, v in values.items() if n not in odd}
        assert len(rest) == 1 and count[rest.pop()] == top, path
        if not any(isinstance(v, (list, dict)) for v in values.values()):
            best = min(text(v) for v in values.values() if count[str(v)] == top)
            assert odd == {n for n, v in values.items() if text(v) != best}, path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_that_grows_with_the_fleet_is_broadcast(spark):
    """Joins over exploded rows look small to Spark: only a row a path and the handful of domains may be broadcast."""
    samples, runs = queries._view(spark, DATA, "energy_samples"), queries._view(spark, DATA, "experiments")
    assert "BroadcastExchange" not in plan_of(energy.run_energy(samples, runs, queries.WRAP))
    assert "BroadcastExchange" not in plan_of(energy.interval_joules(samples, runs, ["node_id", "run_no"], "begin_at", "end_at", queries.WRAP))
    dim = spark.createDataFrame([("p", "package")], "domain string, level string")
    assert plan_of(energy.edp(samples, runs, dim)).count("BroadcastExchange") == 1
    assert plan_of(queries.compare_reports(spark, DATA)).count("BroadcastExchange") == 1


def test_a_run_is_not_walked_by_interpreted_code(spark, capsys):
    """Lambdas are interpreted, and so are generated methods of over 8,000 bytes: no lambda over all captures of a run, and no such method."""
    seen = queries._view(spark, DATA, "captures")
    for operator in (parse.node_identity, parse.tool_presence, parse.freq_probe):
        assert "lambda" not in plan_of(operator(seen)), operator.__name__
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Entries are made by a generated projection below the aggregation, which would interpret them.
        assert "collect_set(entry" in plan_of(parse.by_run(seen).select(*parse.KEY, "every"))
        capsys.readouterr()
        queries.queries()["captured_capabilities"](spark, DATA).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 2 and max(sizes) < 8000


def test_look_ups_of_odd_captures(spark):
    """Against a walk over the rows: sources and items that begin or end alike, nulls, deliveries of any number and order."""
    pairs = [("uname", "hostname"), ("unamehostname", ""), ("uname", None), ("unam", "ehostname"), (None, "uname"), (None, None), ("5:uname", "hostname"), ("powercap_name", "intel-rapl:0"), ("powercap_name", "intel-rapl:0:1"), ("powercap_name", "intel-rapl"), ("powercap_namex", "intel-rapl:9"), ("powercap", "_nameintel-rapl:8"), ("powercap_energy", "\u00e9"), ("which", "perf"), ("which", "perf ")]
    rows = [(node, s, i, (node * 7 + k) % 3 - 1, f"{s}/{i}/{k}" if k % 4 else None, None, None if (node + k + n) % 5 == 0 else (node + k + n) % 4) for node in range(6) for n, (s, i) in enumerate(pairs) for k in range((node * 5 + n) % 4)]
    seen = spark.createDataFrame(rows + rows[::3], "node_id long, source string, item string, rc int, content string, stderr string, t int").selectExpr("node_id", "TIMESTAMP '2026-01-01' AS captured_at", "source", "item", "rc", "content", "stderr", "timestamp_seconds(t) AS received_at")
    newest = {}
    for node, s, i, rc, content, _, t in sorted(rows, key=lambda r: (-1 if r[6] is None else r[6], r[3], r[4] or "")):
        newest[node, s or "", i or ""] = (rc, content or "")
    assert {(r.node_id, r.source, r.item): (r.rc, r.content) for r in parse.once(seen).collect()} == newest
    found = parse.by_run(seen).select("node_id", parse.one("uname", "hostname").alias("host"), parse.done("which", "perf").alias("perf"), parse.has("which").alias("which"), *[parse.every(s).alias(s) for s in parse.LISTED])
    for r in found.collect():
        host = newest.get((r.node_id, "uname", "hostname"))
        assert (r.host and (r.host.rc, r.host.content)) == host and r.perf == (newest.get((r.node_id, "which", "perf"), (1,))[0] == 0) and r.which == any(n == r.node_id and s == "which" for n, s, _ in newest)
        for s in parse.LISTED:
            assert [(x.item, x.rc, x.content) for x in r[s]] == sorted((i, *v) for (n, of, i), v in newest.items() if n == r.node_id and of == s)


def test_counts_are_those_of_the_lists(spark):
    shown = ("00:02.0 VGA compatible controller: Intel Corporation UHD\r\n01:00.0 3D controller: NVIDIA X\r02:00.0 Display controller: AMD\n03:00.0 display: intel with nvidia", "")
    odd = [captures(spark, ("lspci", "", 0, *shown), *more).withColumn("node_id", F.lit(k).cast("long")) for k, more in enumerate([
        [], [("nvidia_gpus", "", 0, "0,a,b,c,d\r\n1,a,b\n2,a,b,c,", "")], [("nvidia_gpus", "", 1, "0,a,b,c,d", "")], [("numactl", "", 0, "node 1 cpus:", ""), ("sysfs_cpulist", "node0", 0, " 0-1\n", ""), ("sysfs_cpulist", "node1", 0, " ", "")], [("numactl", "", 0, " node 1 cpus: 3\nnode 2 cpus: x", ""), ("sysfs_cpulist", "node0", 0, "0-1", "")],
    ])]
    seen = queries._view(spark, DATA, "captures").filter("node_id > 100").select(*odd[0].columns)
    for df in odd:
        seen = seen.unionByName(df)
    got = facts.assemble_facts(seen).select("node_id", "numa", "numa_nodes", "devices", "device_count", "nvidia_count", "intel_count", "nvidia_present", "gpu_present").collect()
    for r in got:
        vendors = Counter(d.vendor for d in r.devices)
        assert r.numa_nodes == len(r.numa) and (r.device_count, r.nvidia_count, r.intel_count) == (len(r.devices), vendors["nvidia"], vendors["intel"]) and r.nvidia_present == (vendors["nvidia"] > 0) and r.gpu_present == (len(r.devices) > 0)
    assert {r.node_id: (r.nvidia_count, r.intel_count, r.numa_nodes) for r in got if r.node_id < 5} == {0: (2, 1, 0), 1: (2, 2, 0), 2: (2, 1, 0), 3: (2, 1, 1), 4: (2, 1, 2)}


@pytest.mark.parametrize("name", ["permission_gap", "readiness_flags"])
def test_a_run_moves_as_one_row_of_fixed_width(spark, name):
    plan = plan_of(queries.queries()[name](spark, DATA))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and all(f"{x}" not in plan for x in ("Window", "Join", "SortAggregate", " Sort "))


def test_permission_gap_of_last_runs(spark):
    runs = queries._view(spark, DATA, "fleet_runs").filter("node_id < 40")
    want = set()
    status = {(r.node_id, r.run_no): r.asDict() for r in assess.assess(runs).collect()}
    for node in {n for n, _ in status}:
        for c in assess.CAPABILITIES:
            user, root = status[node, 2][f"cap_{c}"].status, status[node, 3][f"cap_{c}"].status
            if root == "available" != user:
                want.add((node, c, user, root))
    # A run of a user alone, and one without a time, which any other replaces.
    odd = runs.filter("node_id = 7 AND run_no = 0").withColumn("generated_at", F.lit(None).cast("timestamp"))
    alone = runs.filter("node_id = 8 AND run_no = 0").withColumn("node_id", F.lit(999).cast("long"))
    got = fleet.permission_gap(assess.assess(runs.unionByName(odd).unionByName(alone)))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("name, view", [("stream_captures", "captures"), ("stream_gate", "fleet_runs")])
def test_a_stored_view_is_streamed_without_a_second_copy(spark, monkeypatch, name, view):
    queries._view(spark, DATA, view)
    given = []
    scratch = queries._scratch
    monkeypatch.setattr(queries, "_scratch", lambda spark: given.append(1) or scratch(spark))
    # Only what the stream writes and its state.
    assert queries.queries()[name](spark, DATA).count() and len(given) == 2


def test_energy_stream_is_not_led_through_one_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "_streamed", lambda spark, rows, build, mode: seen.append(plan_of(rows)) or gates.energy_windows(spark.createDataFrame([], gates.ENERGY)))
    queries.stream_energy(spark, DATA)
    assert seen and "Coalesce" not in seen[0]


def test_energy_stream_of_odd_rows(spark, tmp_path):
    """Wraps, equal times, rows without time or reading, a counter without any, late rows in a later batch; by hand."""
    rows = lambda *r: spark.createDataFrame([(n, d, None if t is None else datetime(2026, 1, 1) + timedelta(minutes=t), i, u) for n, d, t, i, u in r], "node_id long, domain string, ts timestamp, sample_id long, energy_uj long").coalesce(1)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in (rows((1, "p", 70, 3, 50), (1, "p", 0, 2, 900), (1, "p", 0, 1, 100), (1, "p", None, 9, 1), (1, "p", 10, 4, None), (2, "p", None, 1, 7)), rows((1, "p", 20, 5, 5), (1, "p", 130, 6, 60), (2, "p", 5, 2, 3))):
        batch.write.mode("append").parquet(source)
        gates.stream_energy(spark.readStream.schema(batch.schema).parquet(source), 1000).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    hour = lambda h: datetime(2026, 1, 1, h)
    got = {(r.node_id, r.start): (r.joules, r.n, r.late) for r in gates.energy_windows(spark.read.parquet(out)).collect()}
    assert got == {(1, hour(0)): (800 / 1e6, 2, 1), (1, hour(1)): (150 / 1e6, 1, 0), (1, hour(2)): (10 / 1e6, 1, 0), (2, hour(0)): (0.0, 1, 0)}


def test_reports_are_written_compressed(spark, tmp_path):
    docs = spark.createDataFrame([(1, datetime(2026, 1, 1), None)], "node_id long, generated_at timestamp, schema_version string")
    reports.write_reports(docs, f"file://{tmp_path}/r")
    files = list((tmp_path / "r").rglob("part-*"))
    assert files and all(f.suffix == ".gz" for f in files)
    assert [(r.node_id, r.schema_version, r.corrupt) for r in reports.read_reports(spark, f"file://{tmp_path}/r", lines=True).collect()] == [(1, None, None)]


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "events", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted([tuple(str(v) for v in r) for r in rows])
    assert plain(got.select(columns).collect()) == plain(want.select(", ".join(columns)).fetchall())
