"""Facts derived from parsed captures, and the assembly of one run's facts: expressions on a run's row, without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.text import KEY, as_int, strip
from rackwise.operators import parse
from rackwise.operators.parse import by_run, done, every, has, leaf, named, of, one

HWP_ADVISORY = "hardware chooses its own P-state within the range; requests are hints"
HWP_NO_EPP = "no energy-performance preference can be set"
PASSIVE = "intel_pstate is passive and takes frequency ranges as acpi-cpufreq does"
OFF = "intel_pstate is off; another driver is in use"
DEVICE_TEXTS = ("name", "driver_version", "vbios_version", "memory_total_mb", "memory_clocks", "graphics_clocks", "bus_id", "index_raw")


def limitations(status: Column, hwp: Column, epp: Column) -> Column:
    texts = F.array(F.when(hwp, HWP_ADVISORY), F.when(hwp & ~epp, HWP_NO_EPP), F.when(~hwp & (status == "passive"), PASSIVE), F.when(~hwp & (status == "off"), OFF))
    return F.filter(texts, lambda x: x.isNotNull())


def control_model(status: Column, hwp: Column) -> Column:
    return F.when(hwp, "hwp_range").when(status == "passive", "pstate_range").otherwise("unknown")


def pstate_columns() -> dict[str, Column]:
    """Null for runs without the driver's directory."""
    found = lambda value: F.when(has("sysfs_pstate"), value)
    status = F.coalesce(leaf("sysfs_pstate", "status"), F.lit(""))
    hwp = one("sysfs_pstate", "hwp_dynamic_boost").isNotNull() | (status == "active")
    epp = one("sysfs_pstate", "energy_performance_preference").isNotNull()
    return {"intel_pstate_status": found(status), "hwp_enabled": found(hwp), "epp_available": found(epp), "control_model": found(control_model(status, hwp)), "driver_limitations": found(limitations(status, hwp, epp))}


def scaling_columns() -> dict[str, Column]:
    """Null for runs without cpufreq leaves."""
    freq = parse.cpufreq_columns()
    discrete = F.size(freq["available_frequencies_khz"]) > 0
    method = F.when(discrete, "discrete").when((freq["base_frequency_khz"] != "") | ((freq["min_khz"] != "") & (freq["max_khz"] != "")), "range").otherwise("unknown")
    model = F.when(discrete, "discrete").otherwise(F.coalesce(pstate_columns()["control_model"], F.lit("unknown")))
    return {"scaling_method": F.when(has("sysfs_cpufreq"), method), "control_model": F.when(has("sysfs_cpufreq"), model)}


def domain_labels() -> Column:
    """Labels of RAPL domains in the order of their directories."""
    rows = F.filter(every("powercap_name"), lambda x: x["item"].startswith("intel-rapl"))
    return F.transform(rows, lambda x: F.when(strip(x["content"]) != "", F.concat(x["item"], F.lit(" ("), strip(x["content"]), F.lit(")"))).otherwise(x["item"]))


def energy_readable() -> Column:
    """Whether there is a domain and any counter could be read."""
    return F.exists(every("powercap_name"), lambda x: x["item"].startswith("intel-rapl")) & F.coalesce(F.exists(every("powercap_energy"), lambda x: x["rc"] == 0), F.lit(False))


def topology_columns(pairs: str = "lscpu") -> dict[str, Column]:
    """0 and `unknown` where nothing is known; where lscpu has no count of CPUs, the operating system's own stands in."""
    text = lambda key: parse.lscpu_value(key, pairs)
    number = lambda key: F.coalesce(as_int(text(key)), F.lit(0))
    own = F.when(done("os_cpu_count"), as_int(one("os_cpu_count")["content"]))
    return {
        "vendor": F.coalesce(text("Vendor ID"), F.lit("unknown")), "model_name": F.coalesce(text("Model name"), F.lit("unknown")), "logical_cpus": F.coalesce(F.nullif(number("CPU(s)"), F.lit(0)), own, F.lit(0)), "sockets": number("Socket(s)"),
        "threads_per_core": number("Thread(s) per core"), "physical_cores": number("Core(s) per socket") * number("Socket(s)"),
    }


def access_columns() -> dict[str, Column]:
    return {"cpufreq_writable": done("access", "scaling_governor_w"), "is_root": done("access", "is_root")}


def cpu_taxonomy_columns(logical: Column) -> dict[str, Column]:
    """present, observable (needs readable energy), controllable (needs a writable governor too), reason."""
    present = logical > 0
    observable = present & energy_readable()
    controllable = observable & done("access", "scaling_governor_w")
    reason = F.when(controllable, F.lit(None)).when(observable, "governor cannot be written").when(present, "energy counters cannot be read").otherwise("no CPUs were found")
    return {"present": present, "observable": observable, "controllable": controllable, "reason": reason}


def all_devices(smi: str = "smi", pci: str = "pci") -> Column:
    """Devices of nvidia-smi, then display adapters; fields a source lacks have defaults."""

    def device(x: Column, vendor: Column, origin: str, own: tuple[str, ...]) -> Column:
        index = x["index"] if "index_raw" in own else F.lit(None).cast("int")
        return F.struct(index.alias("index"), vendor.alias("vendor"), F.lit(origin).alias("origin"), *[(F.coalesce(x[n], F.lit("")) if n in own else F.lit("")).alias(n) for n in DEVICE_TEXTS])

    return F.concat(F.transform(smi, lambda x: device(x, F.lit("nvidia"), "nvidia-smi", tuple(n for n in DEVICE_TEXTS if n != "bus_id"))), F.transform(pci, lambda x: device(x, x["vendor"], "lspci", ("name", "bus_id"))))


def count_columns(smi: str = "smi_fields", pci: str = "pci_lines") -> dict[str, Column]:
    """Of the devices that all_devices lists, counted without making them."""
    lines = lambda v: F.size(F.filter(pci, lambda x: x["vendor"] == v))
    nvidia = (F.size(smi) + lines("nvidia")).cast("long")
    return {"device_count": (F.size(smi) + F.size(pci)).cast("long"), "nvidia_count": nvidia, "intel_count": lines("intel").cast("long"), "nvidia_present": nvidia > 0}


def gpu_taxonomy_columns() -> dict[str, Column]:
    """present, observable (nvidia-smi exists), controllable (clocks were listed), reason."""
    listed = F.exists(every("nvidia_clocks"), lambda x: F.coalesce((x["rc"] == 0) & (x["content"] != ""), F.lit(False))) & ~F.exists(every("nvidia_clocks"), lambda x: x["content"].contains("N/A"))
    nvidia = count_columns()["nvidia_present"]
    present = count_columns()["device_count"] > 0
    observable = present & done("which", "nvidia_smi")
    controllable = observable & nvidia & listed
    reason = F.when(controllable, F.lit(None)).when(observable & ~nvidia, "only NVIDIA clocks can be set and there is no NVIDIA device").when(observable, "nvidia-smi lists no clocks").when(present, "nvidia-smi is missing").otherwise("no GPU was found")
    return {"present": present, "observable": observable, "controllable": controllable, "reason": reason}


def pstate_facts(captures: DataFrame) -> DataFrame:
    """intel_pstate_status, hwp_enabled, epp_available, control_model, driver_limitations; no row without the driver's directory."""
    return by_run(of(captures, "sysfs_pstate")).select(*KEY, *named(pstate_columns()))


def scaling_method(captures: DataFrame) -> DataFrame:
    """scaling_method and control_model of each run that has cpufreq leaves."""
    return by_run(of(captures, "sysfs_cpufreq", "sysfs_pstate")).filter(has("sysfs_cpufreq")).select(*KEY, *named(scaling_columns()))


def rapl_domains(captures: DataFrame) -> DataFrame:
    """domains (labels in the order of their directories), available, readable; no row without a domain."""
    rows = by_run(of(captures, "powercap_name", "powercap_energy")).select(*KEY, domain_labels().alias("domains"), energy_readable().alias("readable")).filter(F.size("domains") > 0)
    return rows.select(*KEY, "domains", F.lit(True).alias("available"), "readable")


def cpu_topology(captures: DataFrame) -> DataFrame:
    """vendor, model_name, logical_cpus, sockets, threads_per_core, physical_cores of every run."""
    return by_run(captures).withColumn("lscpu", parse.lscpu_pairs()).select(*KEY, *named(topology_columns()))


def cpu_taxonomy(captures: DataFrame) -> DataFrame:
    """present, observable, controllable, reason of every run; see cpu_taxonomy_columns."""
    rows = by_run(captures).withColumn("lscpu", parse.lscpu_pairs())
    return rows.withColumn("logical_cpus", topology_columns()["logical_cpus"]).select(*KEY, *named(cpu_taxonomy_columns(F.col("logical_cpus"))))


def _with_all_devices(captures: DataFrame, *sources: str) -> DataFrame:
    return parse.with_devices(captures, *sources).withColumn("pci_lines", parse.pci_lines()).withColumn("pci", parse.pci_adapters()).withColumn("devices", all_devices())


def gpu_devices(captures: DataFrame) -> DataFrame:
    """All devices: those of nvidia-smi, then display adapters; fields a source lacks have defaults."""
    return _with_all_devices(captures, "lspci").select(*KEY, F.inline("devices"))


def gpu_counts(captures: DataFrame) -> DataFrame:
    """device_count, nvidia_count, intel_count, nvidia_present of every run."""
    return _with_all_devices(captures, "*").select(*KEY, *named(count_columns()))


def gpu_taxonomy(captures: DataFrame) -> DataFrame:
    """present, observable, controllable, reason of every run; see gpu_taxonomy_columns."""
    return _with_all_devices(captures, "*").select(*KEY, *named(gpu_taxonomy_columns()))


def permissions(captures: DataFrame) -> DataFrame:
    """Of each run that tried its access."""
    rows = _with_all_devices(captures, "*").filter(has("access"))
    return rows.select(*KEY, done("access", "is_root").alias("is_root"), energy_readable().alias("rapl_readable"), done("access", "scaling_governor_w").alias("cpufreq_writable"), gpu_taxonomy_columns()["controllable"].alias("gpu_clock_control_available"))


def assemble_facts(captures: DataFrame) -> DataFrame:
    """One row for each run that left any capture, with every input of the capability ladders and the arrays that a report lists: devices, numa,
    domains. One shuffle of captures, no join. What a run didn't capture is false, 0, empty or, for identity and texts of a
    missing driver, null."""
    rows = _with_all_devices(captures, "*").withColumn("lscpu", parse.lscpu_pairs()).withColumn("numa", parse.numa_nodes()).withColumn("first", parse.first_reading())
    rows = rows.select("*", *named(topology_columns()), domain_labels().alias("domains"), energy_readable().alias("rapl_readable"))
    perf, freq, metrics, cpufreq, pstate, gpu = parse.perf_columns(), parse.freq_columns(), parse.metric_columns(), parse.cpufreq_columns(), pstate_columns(), gpu_taxonomy_columns()
    cpufreq = {k: F.when(has("sysfs_cpufreq"), v) for k, v in cpufreq.items() if k != "current_raw"}
    false = lambda c: F.coalesce(c, F.lit(False))
    columns = {n: one("uname", n)["content"] for n in parse.IDENTITY} | {n: F.col(n) for n in topology_columns()} | {f"tool_{n}": done("which", n) for n in parse.TOOLS}
    columns |= {"perf_paranoid": perf["event_paranoid_level"], "perf_accessible": perf["accessible"], "perf_note": F.when(has("which"), perf["note"]), "freq_success": false(freq["success"]), "current_khz": F.when(has("sysfs_cpufreq"), freq["current_khz"])}
    columns |= {"domains": F.col("domains"), "rapl_available": F.size("domains") > 0, "rapl_readable": F.col("rapl_readable")}
    columns |= {"rapl_probe_success": F.col("first").isNotNull(), "domain_tested": F.col("first.item"), "sample_value_uj": strip(F.col("first.content"))}
    columns |= {"cpufreq_driver": cpufreq.pop("driver")} | cpufreq
    columns |= {"pstate_status": pstate["intel_pstate_status"], "hwp_enabled": false(pstate["hwp_enabled"]), "epp_available": false(pstate["epp_available"]), "driver_limitations": pstate["driver_limitations"]}
    columns |= scaling_columns() | access_columns() | count_columns()
    columns |= {"gpu_present": gpu["present"], "gpu_observable": gpu["observable"], "gpu_controllable": gpu["controllable"], "gpu_reason": gpu["reason"]}
    columns |= {"gpu_metrics_success": metrics["success"], "temperature_c": F.when(has("nvidia_metrics"), metrics["temperature_c"]), "power_draw_w": F.when(has("nvidia_metrics"), metrics["power_draw_w"])}
    columns |= {"numa_nodes": parse.numa_count(), "numa": F.col("numa"), "devices": F.col("devices"), "cpu_taxonomy": F.struct(*named(cpu_taxonomy_columns(F.col("logical_cpus"))))}
    return rows.select(*KEY, *named(columns))
