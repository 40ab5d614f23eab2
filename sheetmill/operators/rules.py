"""Electrical compatibility rules over tables of driver x receiver pairs.

A rule is a few column expressions over one row per pair; all rules of a pair come out of one
projection (``inline`` of an array of structs), so a pair is read once and nothing is shuffled before
the roll-ups. A rule whose inputs are missing puts out nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.functions.units import current_in_amps

BOLTZMANN = 8.617e-5
ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Rule:
    """``passed`` and ``margin`` are columns of a pair; the rule is absent where ``given`` is not true."""

    layer: int
    rule_id: str
    given: Column
    passed: Column
    margin: Column
    failed_severity: Column | str = ERROR
    passed_severity: Column | str = INFO

    def struct(self) -> Column:
        lit = lambda s: F.lit(s) if isinstance(s, str) else s
        return F.when(
            self.given,
            F.struct(
                F.lit(self.layer).alias("layer"),
                F.lit(self.rule_id).alias("rule_id"),
                self.passed.alias("passed"),
                F.when(self.passed, lit(self.passed_severity)).otherwise(lit(self.failed_severity)).alias("severity"),
                self.margin.cast("double").alias("margin"),
            ),
        )


def all_given(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def static_rules() -> list[Rule]:
    """Levels, noise immunity and drive strength."""
    c = F.col
    supply = F.abs(c("driver_vcc") - c("receiver_vcc"))
    high, low = c("voh") - c("vih"), c("vil") - c("vol")
    swing = c("voh") - c("vol")
    noise = F.least(high, low) / F.nullif(swing, F.lit(0.0))
    ioh, iol = F.abs(current_in_amps(c("ioh"), c("ioh_unit"))), current_in_amps(c("iol"), c("iol_unit"))
    iih, iil = F.abs(current_in_amps(c("iih"), c("iih_unit"))), F.abs(current_in_amps(c("iil"), c("iil_unit")))
    endless = F.lit(float("inf"))
    fan = F.least(F.when(iih > 0, ioh / F.nullif(iih, F.lit(0.0))).otherwise(endless), F.when(iil > 0, iol / F.nullif(iil, F.lit(0.0))).otherwise(endless))
    return [
        Rule(1, "L1-V000", all_given("driver_vcc", "receiver_vcc"), supply <= 0.3, 0.3 - supply),
        Rule(1, "L1-V001", all_given("voh", "vih"), c("voh") >= c("vih"), high),
        Rule(1, "L1-V002", all_given("vol", "vil"), c("vol") <= c("vil"), low),
        Rule(1, "L1-N001", all_given("voh", "vol", "vih", "vil") & (swing != 0), noise >= 0.2, noise - 0.2, WARNING),
        Rule(1, "L1-I001", all_given("ioh", "iih"), ioh >= iih, ioh - iih),
        Rule(1, "L1-I002", all_given("iol", "iil"), iol >= iil, iol - iil),
        Rule(1, "L1-I003", all_given("ioh", "iol", "iih", "iil"), fan >= 1, fan - 1, INFO),
    ]


def line_rules() -> list[Rule]:
    """Critical length and reflections of the trace."""
    c = F.col
    critical = F.least(F.coalesce(c("rise_time"), F.lit(10e-9)), F.coalesce(c("fall_time"), F.lit(10e-9))) * 1e9 * 15 / 6
    known = c("trace_length").isNotNull()
    z0, zs, zl = c("trace_impedance"), F.coalesce(c("output_impedance"), F.lit(25.0)), F.coalesce(c("input_impedance"), F.lit(1e6))
    worst = F.greatest(F.abs((z0 - zs) / (z0 + zs)), F.abs((zl - z0) / (zl + z0)))
    return [
        Rule(2, "L2-T001", F.lit(True), ~known | (c("trace_length") < critical), F.when(known, critical - c("trace_length")), WARNING),
        Rule(2, "L2-R001", z0.isNotNull(), worst < 0.15, 0.15 - worst, WARNING),
    ]


def port_conflicts() -> Column:
    """Names of the conflicts of a pair's port attributes."""
    c = F.col
    there, here = F.coalesce(c("driver_direction"), F.lit("output")), F.coalesce(c("receiver_direction"), F.lit("input"))
    found = F.array(
        F.when((there == "input") & (here == "input"), "no_source"),
        F.when((there == "bidirectional") & (here == "bidirectional"), "bus_contention"),
        F.when((c("driver_pull") == "pull_up") & (c("receiver_pull") == "pull_down"), "pull_up_down"),
        F.when((c("driver_pull") == "pull_down") & (c("receiver_pull") == "pull_up"), "pull_down_up"),
        F.when(F.coalesce(c("driver_tri_state"), F.lit(False)) & (here != "input"), "tri_state"),
    )
    return F.array_compact(found)


def topology_rules() -> list[Rule]:
    """Interface contract and port attributes."""
    c = F.col
    a, b = F.coalesce(c("driver_interface"), F.lit("GPIO")), F.coalesce(c("receiver_interface"), F.lit("GPIO"))
    fits = ((a == b) & a.isin(*dicts.EXACT_INTERFACES)) | F.concat_ws(">", a, b).isin(*(f"{x}>{y}" for x, y in dicts.CONDITIONAL_INTERFACES)) | (a == "GPIO") | (b == "GPIO")
    crossing = F.coalesce(F.abs(c("driver_vcc") - c("receiver_vcc")) > 0.5, F.lit(False))
    clean = F.size(port_conflicts()) == 0
    return [
        Rule(3, "L3-I001", F.lit(True), fits & ~crossing, F.lit(None), F.when(~fits, ERROR).otherwise(WARNING)),
        Rule(3, "L3-P001", F.lit(True), clean, F.lit(None)),
    ]


def process_of(text: Column) -> Column:
    """The process that a text names: exactly, else the first that it contains (BiCMOS before CMOS)."""
    t, out = F.upper(text), F.lit("UNKNOWN")
    for name in reversed(("BiCMOS", "CMOS", "NMOS", "PMOS", "TTL", "ECL")):
        out = F.when(t.contains(name.upper()), name).otherwise(out)
    return F.coalesce(out, F.lit("UNKNOWN"))


def package_of(text: Column) -> Column:
    t, out = F.upper(text), F.lit("UNKNOWN")
    for name in reversed(("DIP", "SOP", "QFP", "BGA", "LGA", "CSP")):
        out = F.when(t.contains(name), name).otherwise(out)
    return F.coalesce(out, F.lit("UNKNOWN"))


def with_degradation(df: DataFrame, table: DataFrame, process: Column, package: Column, voltage: Column, prefix: str, temperature: float, humidity: float = 60.0, hours: float = 1000.0) -> DataFrame:
    """``df`` with ``<prefix>_rate, _factor, _ci_low, _ci_high, _lifetime, _risk``; unknown pairs use CMOS in DIP."""
    keyed = df.withColumns({"_process": process, "_package": package})
    t = F.broadcast(table.withColumnsRenamed({"process": "_process", "package": "_package"}))
    default = next(r for r in dicts.DEGRADATION if r[:2] == ("CMOS", "DIP"))
    joined = keyed.join(t, ["_process", "_package"], "left")
    name = ("c_temp", "c_hum", "c_volt", "base_rate", "energy", "ci_low", "ci_high")
    v = {n: F.coalesce(F.col(n), F.lit(x)) for n, x in zip(name, default[2:], strict=True)}
    arrhenius = F.exp(v["energy"] / BOLTZMANN * (1 / F.lit(25.0 + 273.15) - 1 / F.lit(temperature + 273.15)))
    drift = v["c_temp"] * (temperature - 25.0) + v["c_hum"] * (humidity - 60.0) + v["c_volt"] * (F.coalesce(voltage, F.lit(3.3)) - 3.3)
    rate = v["base_rate"] * arrhenius * (1 + drift)
    factor = F.greatest(1.0 - rate * hours / 1000.0, F.lit(0.1))
    out = joined.withColumns({f"{prefix}_rate": rate, f"{prefix}_factor": factor, "_low": v["ci_low"], "_high": v["ci_high"]})
    f = F.col(f"{prefix}_factor")
    cold, warm = F.lit(temperature <= 85), F.lit(temperature <= 105)
    risk = F.when(f >= 0.95, F.when(cold, "LOW").when(warm, "MEDIUM").otherwise("HIGH")).when(f >= 0.85, F.when(cold, "MEDIUM").otherwise("HIGH")).when(f >= 0.5, "HIGH").otherwise("CRITICAL")
    life = F.when(F.col(f"{prefix}_rate") > 0, 0.5 / (F.col(f"{prefix}_rate") / 1000.0)).otherwise(F.lit(float("inf")))
    out = out.withColumns({f"{prefix}_ci_low": f * F.col("_low"), f"{prefix}_ci_high": f * F.col("_high"), f"{prefix}_lifetime": life, f"{prefix}_risk": risk})
    return out.drop("_process", "_package", "_low", "_high", *name)


def stress_rules(temperature: float) -> list[Rule]:
    """Drift as intervals, and ageing by the worse of the two chips."""
    c = F.col
    drift = abs(temperature - 25.0) * 0.002
    low = {n: c(n) - F.abs(c(n) * drift) for n in ("voh", "vol", "vih", "vil")}
    high = {n: c(n) + F.abs(c(n) * drift) for n in ("voh", "vol", "vih", "vil")}
    hm_low, hm_high = low["voh"] - high["vih"], high["voh"] - low["vih"]
    lm_low, lm_high = low["vil"] - high["vol"], high["vil"] - low["vol"]
    sure = (hm_low > 0) & (lm_low > 0)
    lost = (hm_high < 0) | (lm_high < 0)
    f = F.least(c("driver_factor"), c("receiver_factor"))
    voh, vol, vih, vil = (F.coalesce(c(n), F.lit(d)) for n, d in (("voh", 3.3), ("vol", 0.1), ("vih", 2.0), ("vil", 0.8)))
    aged = F.least(voh * f - vih, vil - vol * (2.0 - f))
    return [
        Rule(4, "L4-T001", all_given("voh", "vol", "vih", "vil"), sure | ~lost, F.least(hm_low, lm_low), WARNING, F.when(sure, INFO).otherwise(WARNING)),
        Rule(4, "L4-P001", F.lit(True), aged >= 0.1, aged - 0.1, WARNING),
    ]


OPTIONAL = ("rise_time", "fall_time", "output_impedance", "input_impedance", "trace_length", "trace_impedance", "driver_vcc", "receiver_vcc")
OPTIONAL_TEXT = ("driver_interface", "receiver_interface", "driver_direction", "receiver_direction", "driver_pull", "receiver_pull", "driver_process", "driver_package", "receiver_process", "receiver_package")


def paired(pairs: DataFrame, drivers: DataFrame, receivers: DataFrame) -> DataFrame:
    """One row for each pair with the parameters of both sides; columns that are not there are null.

    Pairs are dealt by receiver into all partitions of a shuffle before they grow, and stay there when results
    are put together by pair.
    """
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "receiver")
    out = dealt.join(receivers, "receiver").join(drivers, "driver")
    missing = {n: F.lit(None).cast("double") for n in OPTIONAL if n not in out.columns} | {n: F.lit(None).cast("string") for n in OPTIONAL_TEXT if n not in out.columns}
    if "driver_tri_state" not in out.columns:
        missing["driver_tri_state"] = F.lit(False)
    return out.withColumns(missing)


def check_pairs(table: DataFrame, degradation: DataFrame, temperature: float = 85.0, layers: tuple[int, ...] = (1, 2, 3, 4), rules: list[Rule] | None = None, more: list[Rule] | None = None) -> DataFrame:
    """``driver, receiver, layer, rule_id, passed, severity, margin``: a row for each rule that applies to a pair.

    ``rules`` stands for the rules of layers 1 to 3, ``more`` are put behind all rules; a rule is a list of
    expressions over the columns of ``table``.
    """
    rules = [*static_rules(), *line_rules(), *topology_rules()] if rules is None else list(rules)
    if 4 in layers:
        for side in ("driver", "receiver"):
            process = process_of(F.coalesce(F.col(f"{side}_process"), F.lit("CMOS")))
            package = package_of(F.coalesce(F.col(f"{side}_package"), F.lit("DIP")))
            table = with_degradation(table, degradation, process, package, F.col(f"{side}_vcc"), side, temperature)
        rules += stress_rules(temperature)
    rules += more or []
    # Rules that do not apply go as rows: dropping them inside the array would keep all rules from being compiled.
    found = F.array(*(r.struct() for r in rules if r.layer in layers))
    return table.select("driver", "receiver", F.inline(found)).where("layer is not null")


def layer_results(results: DataFrame) -> DataFrame:
    """Each layer of a pair: layers 1 and 3 pass without a failed error, 2 and 4 without a failed warning."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    out = results.groupBy("driver", "receiver", "layer").agg(F.count("*").alias("rules"), F.count_if("passed").alias("rules_passed"), failed(ERROR).alias("errors"), failed(WARNING).alias("warnings"))
    return out.withColumn("passed", F.when(F.col("layer").isin(1, 3), F.col("errors") == 0).otherwise(F.col("warnings") == 0))


def overall_results(layers: DataFrame) -> DataFrame:
    """Each pair: compatible if layers 1 and 3 pass; the share of rules passed; layers that need advice."""
    ok = lambda n: F.bool_and(F.when(F.col("layer") == n, F.col("passed")))
    out = layers.groupBy("driver", "receiver").agg(
        (F.coalesce(ok(1), F.lit(False)) & F.coalesce(ok(3), F.lit(False))).alias("compatible"),
        (F.sum("rules_passed") / F.sum("rules")).alias("confidence"),
        (~(F.coalesce(ok(2), F.lit(True)) & F.coalesce(ok(4), F.lit(True)))).alias("has_warnings"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat(F.lit("layer"), F.col("layer").cast("string"))))), ",").alias("advice"),
    )
    return out


def categorised(results: DataFrame) -> DataFrame:
    """Each pair: rules passed, failed warnings, other failures."""
    kind = F.when(F.col("passed"), "info").when(F.col("severity") == WARNING, "warning").otherwise("error")
    return results.groupBy("driver", "receiver").agg(*(F.count_if(kind == k).alias(f"n_{k}") for k in ("error", "warning", "info")))


def rule_report(results: DataFrame) -> DataFrame:
    """How many pairs each rule and layer, and all together, saw and failed."""
    counts = results.groupBy("layer", "rule_id").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("bad"))
    # Only the counts of each rule are added up for layers and all.
    out = counts.rollup("layer", "rule_id").agg(F.sum("n").alias("checked"), F.sum("bad").alias("failed"))
    return out.withColumns({"layer": F.coalesce("layer", F.lit(0)), "rule_id": F.coalesce("rule_id", F.lit("all"))})


def interface_of(name: Column) -> Column:
    """The interface that a part number suggests."""
    n, out = F.upper(name), F.lit("GPIO")
    for mark, kind in (("ADC", "ADC"), ("PWM", "PWM"), ("CAN", "CAN"), ("UART", "UART"), ("I2C", "I2C"), ("SPI", "SPI")):
        out = F.when(n.contains(mark), kind).otherwise(out)
    return F.coalesce(out, F.lit("GPIO"))


def with_trace_estimate(df: DataFrame) -> DataFrame:
    """A tenth of the way that a signal goes in its shortest edge (15 cm in a nanosecond), else 5 cm; 50 ohms."""
    edge = F.least("rise_time", "fall_time")
    return df.withColumns({"est_length": F.when(edge > 0, edge * 1e9 * 15 / 10).otherwise(F.lit(5.0)), "est_impedance": F.lit(50.0)})
