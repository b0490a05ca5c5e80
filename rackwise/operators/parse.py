"""Recorded captures to facts. Captures are (node_id, captured_at, source, item, rc, content, stderr) and, where the collector notes it,
received_at. A capture may be delivered any number of times: of one run's captures of one source and item the newest counts (then the
greatest rc, content and stderr), so every operator gives the same for captures delivered once and again.

One aggregation by run gathers a run's captures in a row: it is the only shuffle, equal deliveries are dropped before it, and what it holds is bounded
by one run's different captures. All parsers are expressions on that row; the operators read only the sources they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.text import KEY, as_int, cpu_list, lines, strip

TOOLS = ("perf", "cpupower", "numactl", "nvidia_smi")
IDENTITY = ("hostname", "os", "kernel", "architecture")
#: Sources with any number of items, which are read as lists.
LISTED = ("powercap_name", "powercap_energy", "sysfs_cpulist", "nvidia_clocks")
#: Sources that are asked for as such.
SOURCES = ("sysfs_pstate", "sysfs_cpufreq", "which", "access", "nvidia_metrics")
CPUFREQ = ("scaling_driver", "scaling_governor", "scaling_available_governors", "scaling_cur_freq", "cpuinfo_min_freq", "cpuinfo_max_freq", "base_frequency", "scaling_available_frequencies")
#: Source and item of captures that are looked up singly.
LEAVES = (
    *[(s, "") for s in ("lscpu", "os_cpu_count", "perf_stat", "numactl", "nvidia_gpus", "nvidia_metrics", "lspci")], *[("uname", n) for n in IDENTITY], *[("which", n) for n in TOOLS], ("access", "scaling_governor_w"), ("access", "is_root"),
    ("procfs", "perf_event_paranoid"), *[("sysfs_cpufreq", n) for n in CPUFREQ], *[("sysfs_pstate", n) for n in ("status", "hwp_dynamic_boost", "energy_performance_preference")],
)
NUMA_LINE = r"^node\s+(\d+)\s+cpus:\s+(.+)$"


def of(captures: DataFrame, *sources: str) -> DataFrame:
    return captures.filter(F.col("source").isin(*sources))


def by_run(captures: DataFrame) -> DataFrame:
    """One row a run: `every`, its captures, each key's newest first, `keys`, for each source of SOURCES and LISTED where it begins in `every`, for each pair of LEAVES where its
    newest capture lies (from 1, 0 for none), and for each source of LISTED its captures once each by item. Columns that nobody reads aren't made. What is looked up is
    found by native functions: functions with a lambda are interpreted and only walk the short lists."""
    received = F.col("received_at") if "received_at" in captures.columns else F.lit(None)
    source, item = (F.coalesce(c, F.lit("")) for c in ("source", "item"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    entry = F.struct(F.concat(F.length(source).cast("string"), F.lit(":"), source, item).alias("key"), received.cast("timestamp").alias("received_at"), "rc", text("content"), text("stderr"), source.alias("source"))
    # explode() keeps the making of entries out of the aggregation, which would interpret it.
    made = captures.select(*KEY, F.explode(F.array(entry)).alias("entry"))
    found = made.groupBy(*KEY).agg(F.sort_array(F.collect_set("entry"), asc=False).alias("every"))
    found = found.select(*KEY, "every", F.col("every.key").alias("keys"), F.col("every.source").alias("sources"), F.reverse("every.source").alias("back"))
    found = found.select(*KEY, "every", "keys", "back", *[F.array_position("sources", s).alias(f"from_{s}") for s in (*SOURCES, *LISTED)])
    found = found.select("*", *[_stretch(s).alias(f"all_{s}") for s in LISTED])
    # With the lists' lambdas in one projection Spark makes short methods of the look-ups, which the JVM compiles; one method of all would pass its limit of 8,000 bytes.
    leaves = [F.array_position("keys", _key(*leaf)).alias(_at(*leaf)) for leaf in LEAVES]
    return found.select(*KEY, "every", "keys", *[f"from_{s}" for s in SOURCES], *leaves, *[_newest(s).alias(f"of_{s}") for s in LISTED])


def _key(source: str, item: str) -> str:
    return f"{len(source)}:{source}{item}"


def _at(source: str, item: str) -> str:
    return f"at_{source}_{item}"


def _stretch(source: str) -> Column:
    """The part of `every` that holds a source."""
    first, after = F.col(f"from_{source}"), F.size("back") + 1 - F.array_position("back", source)
    return F.when(first > 0, F.slice("every", first.cast("int"), (after - first + 1).cast("int"))).otherwise(F.slice("every", 1, 0))


def _newest(source: str) -> Column:
    """Each item's first capture in the source's part of `every`, by item."""
    rows = f"all_{source}"
    kept = F.filter(rows, lambda x, i: ~F.get(rows, i - 1)["key"].eqNullSafe(x["key"]))
    return F.reverse(F.transform(kept, lambda x: F.struct(F.substring(x["key"], len(_key(source, "")) + 1, 2**31 - 1).alias("item"), *[x[n].alias(n) for n in ("rc", "content", "stderr")])))


def one(source: str, item: str = "") -> Column:
    """(rc, content, stderr) of a pair of LEAVES; null if it wasn't captured."""
    return F.get("every", F.col(_at(source, item)) - 1)


def every(source: str) -> Column:
    """All captures of a source of LISTED, by item."""
    return F.col(f"of_{source}")


def has(source: str) -> Column:
    return F.col(f"from_{source}") > 0


def done(source: str, item: str = "") -> Column:
    """Whether it was captured with return code 0."""
    return F.coalesce(one(source, item)["rc"] == 0, F.lit(False))


def shown(source: str, item: str = "") -> Column:
    """Its lines, if it ended well; no lines otherwise."""
    return F.when(done(source, item) & (one(source, item)["content"] != ""), lines(one(source, item)["content"])).otherwise(F.array().cast("array<string>"))


def leaf(source: str, item: str) -> Column:
    """A file's text, stripped; null if it wasn't captured."""
    return strip(one(source, item)["content"])


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def lscpu_pairs() -> Column:
    """key and value of each `Key: Value` line."""
    return F.transform(F.filter(shown("lscpu"), lambda x: x.contains(":")), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substr(x, F.locate(":", x) + 1)).alias("value")))


def lscpu_value(key: str, pairs: str = "lscpu") -> Column:
    """A key's last value in the column of pairs."""
    return F.try_element_at(F.filter(pairs, lambda x: x["key"] == key), F.lit(-1))["value"]


def clock_lists() -> Column:
    """index_raw, memory, graphics of each device whose clocks were listed: distinct, rising."""
    found = lambda text, name: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{name}\s*:\s*(\d+)\s*MHz"), F.lit(1)), lambda x: x.cast("int"))))
    listed = F.filter(every("nvidia_clocks"), lambda x: x["rc"] == 0)
    return F.transform(listed, lambda x: F.struct(x["item"].alias("index_raw"), found(x["content"], "Memory").alias("memory"), found(x["content"], "Graphics").alias("graphics")))


def smi_fields() -> Column:
    """The fields of each device of five fields in nvidia-smi's list."""
    return F.filter(F.transform(shown("nvidia_gpus"), lambda x: F.split(x, ",")), lambda f: F.size(f) == 5)


def smi_devices(clocks: str = "clocks", fields: str = "smi_fields") -> Column:
    """Devices from the column of their fields, with each one's clocks, from the column of clock lists, as text."""
    rows = F.transform(fields, lambda x: F.transform(x, strip))
    own = lambda f, kind: F.coalesce(F.array_join(F.get(F.filter(clocks, lambda c: c["index_raw"] == f[0]), F.lit(0))[kind].cast("array<string>"), ","), F.lit(""))
    return F.transform(rows, lambda f: F.struct(f[0].alias("index_raw"), as_int(f[0]).alias("index"), *[f[i].alias(n) for i, n in enumerate(("name", "driver_version", "vbios_version", "memory_total_mb"), 1)], own(f, "memory").alias("memory_clocks"), own(f, "graphics").alias("graphics_clocks")))


def pci_lines(fields: str = "smi_fields") -> Column:
    """vendor and text of display-class lines of the two vendors; NVIDIA lines count only where the column of nvidia-smi's devices is empty."""
    low = lambda x: F.lower(x)
    display = F.filter(shown("lspci"), lambda x: low(x).rlike("vga|3d|display"))
    vendor = lambda x: F.when(low(x).contains("nvidia") & (F.size(fields) == 0), "nvidia").when(low(x).contains("intel"), "intel")
    return F.filter(F.transform(display, lambda x: F.struct(vendor(x).alias("vendor"), x.alias("text"))), lambda x: x["vendor"].isNotNull())


def pci_adapters(rows: str = "pci_lines") -> Column:
    """vendor, bus_id, name of the column of display-class lines."""
    return F.transform(rows, lambda x: F.struct(x["vendor"].alias("vendor"), F.substring_index(x["text"], " ", 1).alias("bus_id"), strip(F.element_at(F.split(x["text"], ":", 3), -1)).alias("name")))


def numa_nodes(separators: str = ",") -> Column:
    """numa_id, origin, cpus: from numactl, or from sysfs where numactl has no matching line. Nodes without a list of CPUs (memory only)
    are left out on both paths."""
    first, rest = numa_lines()
    node = lambda numa_id, origin, text: F.struct(numa_id.alias("numa_id"), F.lit(origin).alias("origin"), cpu_list(text, separators).alias("cpus"))
    return F.when(F.size(first) > 0, F.transform(first, lambda x: node(F.regexp_extract(x, NUMA_LINE, 1), "numactl", F.regexp_extract(x, NUMA_LINE, 2)))).otherwise(F.transform(rest, lambda x: node(F.regexp_replace(x["item"], "^node", ""), "sysfs", x["content"])))


def numa_lines() -> tuple[Column, Column]:
    """numactl's lines of nodes with CPUs, and sysfs's captures of such."""
    return F.filter(F.transform(shown("numactl"), strip), lambda x: x.rlike(NUMA_LINE)), F.filter(every("sysfs_cpulist"), lambda x: strip(x["content"]) != "")


def numa_count() -> Column:
    """How many nodes numa_nodes gives, without their lists."""
    first, rest = numa_lines()
    return F.coalesce(F.nullif(F.size(first), F.lit(0)), F.size(rest))


def perf_columns() -> dict[str, Column]:
    level, stat = as_int(one("procfs", "perf_event_paranoid")["content"]), one("perf_stat")
    ran = done("which", "perf") & done("perf_stat")
    failed = F.concat(F.lit("perf stat returned "), F.coalesce(stat["rc"].cast("string"), F.lit("nothing")), F.lit(": "), F.coalesce(F.nullif(stat["stderr"], F.lit("")), F.lit("unknown error")), F.when(level >= 3, F.concat(F.lit("; level "), level.cast("string"), F.lit(" shuts out all but root"))).otherwise(""))
    note = F.when(~done("which", "perf"), "perf is not installed").when(ran & (level >= 2), F.concat(F.lit("perf works; level "), level.cast("string"), F.lit(" keeps kernel profiling from users"))).when(ran, "perf works without restriction").otherwise(failed)
    return {"event_paranoid_level": level, "accessible": ran, "note": note}


def freq_columns() -> dict[str, Column]:
    now = F.coalesce(leaf("sysfs_cpufreq", "scaling_cur_freq"), F.lit(""))
    return {"success": now.rlike("^[0-9]+$"), "current_khz": F.when(now.rlike("^[0-9]+$"), now).otherwise("")}


def metric_columns(smi: str = "smi_fields") -> dict[str, Column]:
    """Of the first line; success needs a device in the column of nvidia-smi's devices, the tool, return code 0 and two fields."""
    fields = F.split(F.get(lines(one("nvidia_metrics")["content"]), F.lit(0)), ",")
    good = done("nvidia_metrics") & done("which", "nvidia_smi") & (F.size(smi) > 0) & F.coalesce(F.size(fields) >= 2, F.lit(False))
    field = lambda i: F.when(good, strip(F.get(fields, F.lit(i)))).otherwise("")
    return {"success": good, "temperature_c": field(0), "power_draw_w": field(1)}


def first_reading() -> Column:
    """The first RAPL domain, in order, with a numeric reading."""
    return F.get(F.filter(every("powercap_energy"), lambda x: (x["rc"] == 0) & strip(x["content"]).rlike("^[0-9]+$")), F.lit(0))


def cpufreq_columns() -> dict[str, Column]:
    text = lambda item: F.coalesce(leaf("sysfs_cpufreq", item), F.lit(""))
    return {
        "driver": text("scaling_driver"), "governor_current": text("scaling_governor"), "governors_available": words(leaf("sysfs_cpufreq", "scaling_available_governors")), "min_khz": text("cpuinfo_min_freq"), "max_khz": text("cpuinfo_max_freq"),
        "base_frequency_khz": text("base_frequency"), "available_frequencies_khz": words(leaf("sysfs_cpufreq", "scaling_available_frequencies")), "current_raw": text("scaling_cur_freq"),
    }


def named(columns: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in columns.items()]


def once(captures: DataFrame) -> DataFrame:
    """Each capture once, in its newest form."""
    item = lambda x: F.substring(x["key"], F.length(x["source"]) + F.length(F.length(x["source"]).cast("string")) + 2, F.length(x["key"]))
    newest = F.filter("every", lambda x, i: ~F.get("keys", i - 1).eqNullSafe(x["key"]))
    rows = F.transform(newest, lambda x: F.struct(x["source"].alias("source"), item(x).alias("item"), *[x[n].alias(n) for n in ("rc", "content", "stderr")]))
    return by_run(captures).select(*KEY, F.inline(rows))


def ok_captures(captures: DataFrame) -> DataFrame:
    """Results that can be used: return code 0 and some output."""
    return once(captures).filter((F.col("rc") == 0) & (F.col("content") != ""))


def kv_facts(captures: DataFrame) -> DataFrame:
    """key, value of the `Key: Value` lines of lscpu; the last of equal keys wins."""
    rows = by_run(of(captures, "lscpu")).select(*KEY, F.posexplode(lscpu_pairs()).alias("pos", "pair"))
    return rows.groupBy(*KEY, F.col("pair.key").alias("key")).agg(F.max_by("pair.value", "pos").alias("value"))


def cpu_list_rows(captures: DataFrame) -> DataFrame:
    """One row for each CPU of each recorded list, in order."""
    return once(of(captures, "sysfs_cpulist")).select(*KEY, "item", F.posexplode(cpu_list(F.col("content"))).alias("position", "cpu"))


def supported_clocks(captures: DataFrame) -> DataFrame:
    """kind, mhz: distinct memory and graphics clocks for each device, rising; failed commands have none."""
    wide = by_run(of(captures, "nvidia_clocks")).select(*KEY, F.inline(clock_lists()))
    return wide.unpivot([*KEY, "index_raw"], ["memory", "graphics"], "kind", "clocks").select(*KEY, "index_raw", "kind", F.posexplode("clocks").alias("position", "mhz"))


def with_devices(captures: DataFrame, *sources: str) -> DataFrame:
    """Runs with the columns clocks, smi_fields and smi."""
    rows = by_run(of(captures, "nvidia_clocks", "nvidia_gpus", *sources)) if sources != ("*",) else by_run(captures)
    return rows.withColumns({"clocks": clock_lists(), "smi_fields": smi_fields()}).withColumn("smi", smi_devices())


def nvidia_devices(captures: DataFrame) -> DataFrame:
    """Device rows of five fields, with each device's clocks as text."""
    return with_devices(captures).select(*KEY, F.inline("smi"))


def pci_display_adapters(captures: DataFrame) -> DataFrame:
    """vendor, bus_id, name of display-class lines; NVIDIA lines count only where nvidia-smi found no device."""
    return with_devices(captures, "lspci").withColumn("pci_lines", pci_lines()).select(*KEY, F.inline(pci_adapters()))


def numa_topology(captures: DataFrame, separators: str = ",") -> DataFrame:
    """numa_id, origin, cpus of each NUMA node with CPUs; see numa_nodes."""
    return by_run(of(captures, "numactl", "sysfs_cpulist")).select(*KEY, F.inline(numa_nodes(separators)))


def tool_presence(captures: DataFrame) -> DataFrame:
    """Which of the four tools exist; one that wasn't recorded does not."""
    return by_run(of(captures, "which")).select(*KEY, *[done("which", n).alias(f"tool_{n}") for n in TOOLS])


def node_identity(captures: DataFrame) -> DataFrame:
    return by_run(of(captures, "uname")).select(*KEY, *[one("uname", n)["content"].alias(n) for n in IDENTITY])


def sysfs_pivot(captures: DataFrame) -> DataFrame:
    """The cpufreq leaves of a run as columns; lists split at white space."""
    return by_run(of(captures, "sysfs_cpufreq")).select(*KEY, *named(cpufreq_columns()))


def perf_probe(captures: DataFrame) -> DataFrame:
    """event_paranoid_level, accessible, note for each run whose tools were looked for."""
    return by_run(of(captures, "which", "procfs", "perf_stat")).filter(has("which")).select(*KEY, *named(perf_columns()))


def freq_probe(captures: DataFrame) -> DataFrame:
    return by_run(of(captures, "sysfs_cpufreq")).select(*KEY, *named(freq_columns()))


def gpu_metrics(captures: DataFrame) -> DataFrame:
    """Temperature and power, see metric_columns, of each run that asked for them."""
    return with_devices(captures, "nvidia_metrics", "which").filter(has("nvidia_metrics")).select(*KEY, *named(metric_columns()))


def rapl_probe(captures: DataFrame) -> DataFrame:
    """The first domain, in order, with a numeric energy reading; runs without one have no row."""
    rows = by_run(of(captures, "powercap_energy")).select(*KEY, first_reading().alias("one")).filter("one IS NOT NULL")
    return rows.select(*KEY, F.lit(True).alias("success"), F.col("one.item").alias("domain_tested"), strip(F.col("one.content")).alias("sample_value_uj"))
