"""Reliability-aware scoring of devices inside comparison groups.

Input is long: ``group_id, device, param, value, source, temperature, voltage``. Every step is a window
or an aggregate by group, so many groups are scored in one job and no matrix is ever built: rows are
partitioned by (group, param) for column statistics and by (group, device) for row sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmill.functions import dicts

MISSING = 0.3


def normalised_conditions(df: DataFrame, temperature_coefficients: DataFrame | None = None, voltage_coefficients: DataFrame | None = None) -> DataFrame:
    """``df`` with ``norm_value, confidence, adjusted``: values as they would be at 25 degrees and 3.3 V."""
    spark = df.sparkSession
    t = F.broadcast(temperature_coefficients or dicts.temperature_coefficients(spark))
    v = F.broadcast(voltage_coefficients or dicts.voltage_coefficients(spark))
    d = df.join(t, "param", "left").join(v, "param", "left")
    dt, dv = F.col("temperature") - 25.0, F.col("voltage") - 3.3
    t_fix, v_fix = 1 + (F.col("t_coeff") - 1) * (dt / 100), 1 + (F.col("v_coeff") - 1) * (dv / 3.3)
    by_t = F.coalesce((F.abs(dt) > 1) & F.col("t_type").isin("resistance", "delay", "power", "current") & (t_fix > 0), F.lit(False))
    by_v = F.coalesce((F.abs(dv) > 0.5) & (v_fix > 0), F.lit(False))
    none = F.col("temperature").isNull() & F.col("voltage").isNull()
    confidence = F.when(by_t & (F.abs(dt) > 50), 0.90).otherwise(1.0) * F.when(by_t & (F.abs(dt) > 100), 0.85).otherwise(1.0) * F.when(by_v, 0.92).otherwise(1.0)
    value = F.col("value") / F.when(by_t, t_fix).otherwise(1.0) / F.when(by_v, v_fix).otherwise(1.0)
    out = d.withColumns({"norm_value": F.when(none, F.col("value")).otherwise(value), "confidence": F.when(none, 0.85).otherwise(confidence), "adjusted": ~none & (by_t | by_v)})
    return out.drop("t_coeff", "t_type", "v_coeff")


def tfn(l: Column, m: Column, r: Column) -> Column:
    return F.struct(l.alias("l"), m.alias("m"), r.alias("r"))


def tfn_around(value: Column, spread: Column) -> Column:
    return tfn(value - spread, value, value + spread)


def defuzzified(t: Column) -> Column:
    return (t["l"] + 4 * t["m"] + t["r"]) / 6


def z_numbers(df: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``df`` with ``reliability``, the value ``z_a`` and its reliability ``z_b`` as triangular numbers.

    A column ``uncertainty`` gives the spread of the value where it is not null.
    """
    s = F.broadcast(sources or dicts.sources(df.sparkSession))
    d = df.join(s, "source", "left")
    reliability = F.coalesce("base_reliability", F.lit(0.5)) * F.col("confidence") * F.when(F.col("adjusted"), 0.90).otherwise(1.0)
    spread = F.abs("norm_value") * F.coalesce("base_spread", F.lit(0.15)) * F.when(F.col("adjusted"), 1.2).otherwise(1.0)
    if "uncertainty" in df.columns:
        spread = F.coalesce("uncertainty", spread)
    d = d.withColumns({"reliability": reliability, "_spread": spread})
    b = F.col("reliability") * 0.10
    z_b = tfn(F.greatest(F.lit(0.0), F.col("reliability") - b), F.col("reliability"), F.least(F.lit(1.0), F.col("reliability") + b))
    return d.withColumns({"z_a": tfn_around(F.col("norm_value"), F.col("_spread")), "z_b": z_b}).drop("_spread", "base_reliability", "base_spread")


def converted(df: DataFrame) -> DataFrame:
    """``df`` with ``fuzzy``, the value widened by its unreliability, and ``weighted_value``."""
    alpha = F.least(F.greatest(defuzzified(F.col("z_b")), F.lit(0.01)), F.lit(0.99))
    wide, a = 1 + (1 - alpha), F.col("z_a")
    out = df.withColumn("fuzzy", tfn(a["m"] - (a["m"] - a["l"]) * wide, a["m"], a["m"] + (a["r"] - a["m"]) * wide))
    return out.withColumn("weighted_value", defuzzified(F.col("fuzzy")))


def aggregated_z(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted sums of Z-numbers, part by part; equal weights by default."""
    n = F.count("*")
    w = F.lit(1.0) if weight is None else weight
    scale = n if weight is None else F.lit(1.0)
    part = lambda z, k: (F.sum(w * F.col(z)[k]) / scale).alias(f"{z[-1]}_{k}")
    return df.groupBy(*by).agg(*(part(z, k) for z in ("z_a", "z_b") for k in ("l", "m", "r")))


def dense(df: DataFrame) -> DataFrame:
    """A row for each device and each parameter of its group; ``missing`` where there was none."""
    devices = df.select("group_id", "device").distinct()
    params = df.select("group_id", "param").distinct()
    grid = devices.join(params, "group_id")
    return grid.join(df, ["group_id", "device", "param"], "left").withColumn("missing", F.col("weighted_value").isNull())


def by_param():
    return Window.partitionBy("group_id", "param")


def by_device():
    return Window.partitionBy("group_id", "device")


def by_group():
    return Window.partitionBy("group_id")


def min_max(df: DataFrame, parameters: DataFrame | None = None, missing_as_zero: bool = False) -> DataFrame:
    """``df`` with ``norm`` in 0..1; a constant column is 0.5, a missing value 0."""
    p = F.broadcast(parameters or dicts.parameters(df.sparkSession))
    v = F.when(F.col("missing"), F.lit(0.0) if missing_as_zero else None).otherwise(F.col("weighted_value"))
    d = df.join(p, "param", "left").withColumns({"_v": v, "_lo": F.min(v).over(by_param()), "_hi": F.max(v).over(by_param())})
    span = F.col("_hi") - F.col("_lo")
    target = F.coalesce("target", (F.col("_lo") + F.col("_hi")) / 2)
    far = F.greatest(F.abs(F.col("_hi") - target), F.abs(F.col("_lo") - target))
    norm = (
        F.when(F.col("missing"), 0.0)
        .when(span < 1e-10, 0.5)
        .when(F.col("kind") == "cost", (F.col("_hi") - F.col("_v")) / F.nullif(span, F.lit(0.0)))
        .when(F.col("kind") == "target", 1.0 - F.abs(F.col("_v") - target) / F.nullif(far, F.lit(0.0)))
        .otherwise((F.col("_v") - F.col("_lo")) / F.nullif(span, F.lit(0.0)))
    )
    return d.withColumn("norm", norm).drop("_v", "_lo", "_hi")


def merec(df: DataFrame) -> DataFrame:
    """``df`` with ``weight``: how much a group's scores change when the parameter is left out."""
    lo, hi = F.min("norm").over(by_param()), F.max("norm").over(by_param())
    d = df.withColumns({"_lo": lo, "_hi": hi})
    r = F.when(F.col("_hi") - F.col("_lo") < 1e-10, 1.0).when(F.col("kind") == "cost", F.col("_lo") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1e-10)).otherwise(F.col("norm") / F.when(F.col("_hi") > 0, F.col("_hi")).otherwise(1.0))
    d = d.withColumn("_r", F.abs(r))
    d = d.withColumns({"_sum": F.sum("_r").over(by_device()), "_m": F.count("*").over(by_device())})
    without = F.log(1 + (F.col("_sum") - F.col("_r")) / F.greatest(F.col("_m") - 1, F.lit(1)))
    d = d.withColumn("_effect", F.abs(without - F.log(1 + F.col("_sum") / F.col("_m"))))
    d = d.withColumns({"_e": F.sum("_effect").over(by_param()), "_all": F.sum("_effect").over(by_group()), "_n": F.count("*").over(by_param())})
    weight = F.when((F.col("_all") > 1e-10) & (F.col("_n") > 1), F.col("_e") / F.nullif(F.col("_all"), F.lit(0.0))).otherwise(1 / F.col("_m"))
    return d.withColumn("weight", weight).drop("_lo", "_hi", "_r", "_sum", "_m", "_effect", "_e", "_all", "_n")


def device_scores(df: DataFrame) -> DataFrame:
    """Each device: distance to the expected point, confidence of its data, score (0 to 100), rank."""
    f = F.col("fuzzy")
    spread = f["r"] - f["l"]
    unsure = F.when(F.abs(f["m"]) > 1e-10, spread / (2.0 * F.nullif(F.abs(f["m"]), F.lit(0.0)))).when(spread < 1e-10, 0.0).otherwise(1.0)
    sure = F.when(F.col("missing"), MISSING).otherwise(1.0 - F.least(unsure, F.lit(1.0)))
    d = df.groupBy("group_id", "device").agg(
        F.sqrt(F.sum(F.col("weight") * F.pow(F.col("norm") - F.coalesce("esp", F.lit(0.6)), F.lit(2.0)))).alias("distance"),
        F.sum(F.col("weight") * sure).alias("confidence"),
    )
    score = (0.7 * (1.0 - F.col("distance") / (F.max("distance").over(by_group()) + 1e-10)) + 0.3 * F.col("confidence")) * 100
    d = d.withColumn("score", score)
    return d.withColumn("rank", F.row_number().over(by_group().orderBy(F.desc(F.round("score", 9)), "device")))


def dimension_scores(df: DataFrame) -> DataFrame:
    """Each device: weighted means by dimension, times 100; 50 where the group has no such parameter."""
    d = df.where("dimension is not null").groupBy("group_id", "device", "dimension").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("norm")).alias("wx"), F.avg("norm").alias("plain"))
    d = d.withColumn("s", F.when(F.col("w") > 0, F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))).otherwise(F.col("plain")) * 100)
    wide = df.select("group_id", "device").distinct().join(d, ["group_id", "device"], "left").groupBy("group_id", "device").pivot("dimension", list(dicts.DIMENSIONS)).agg(F.max("s"))
    return wide.select("group_id", "device", *(F.least(F.greatest(F.coalesce(n, F.lit(50.0)), F.lit(0.0)), F.lit(100.0)).alias(n) for n in dicts.DIMENSIONS))


def strengths(df: DataFrame, near: float = 0.05) -> DataFrame:
    """Each device: parameters within ``near`` of the best (4 at most) and worst (3) of the others, in order."""
    up, down = by_param().orderBy(F.desc("norm"), "device"), by_param().orderBy("norm", "device")
    d = df.withColumns({"_top": F.row_number().over(up), "_low": F.row_number().over(down)})
    first = lambda col, w: F.max(F.when(F.col(col) == 1, F.col("norm"))).over(w)
    second = lambda col, w: F.max(F.when(F.col(col) == 2, F.col("norm"))).over(w)
    d = d.withColumns({"_max": F.when(F.col("_top") == 1, second("_top", by_param())).otherwise(first("_top", by_param())), "_min": F.when(F.col("_low") == 1, second("_low", by_param())).otherwise(first("_low", by_param()))})
    judged = F.col("kind").isin("benefit", "cost")
    good = judged & (F.col("norm") >= F.col("_max") - near)
    bad = judged & ~(F.col("norm") >= F.col("_max") - near) & (F.col("norm") <= F.col("_min") + near)
    listed = lambda c, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("param_no", "param")))), lambda x: x["param"]), 1, n), ",")
    return d.groupBy("group_id", "device").agg(listed(good, 4).alias("strong"), listed(bad, 3).alias("weak"))


def matrix(df: DataFrame, **options) -> DataFrame:
    """All steps up to the weights."""
    return merec(min_max(dense(converted(z_numbers(normalised_conditions(df)))), **options))


def recommendations(scores: DataFrame) -> DataFrame:
    """Each group: the best device, the next one, and how reliable the best one's data are."""
    band = F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") > 0.6, "medium").otherwise("low")
    s = scores.withColumn("band", band)
    pick = lambda col, k: F.max(F.when(F.col("rank") == k, F.col(col)))
    return s.groupBy("group_id").agg(pick("device", 1).alias("best"), pick("score", 1).alias("best_score"), pick("band", 1).alias("reliability"), pick("device", 2).alias("second"), pick("score", 2).alias("second_score"))


def headlines(scores: DataFrame) -> DataFrame:
    """Each group: winner, lead over the next one, mean confidence."""
    s = scores.withColumn("lead", F.col("score") - F.lead("score").over(by_group().orderBy("rank")))
    return s.groupBy("group_id").agg(F.min_by("device", "rank").alias("winner"), F.min_by("lead", "rank").alias("lead"), F.avg("confidence").alias("mean_confidence"))


def differences(df: DataFrame, digits: int = 4) -> DataFrame:
    """Each group and parameter: whether values differ, some are missing, or test conditions differ."""
    n = df.groupBy("group_id").agg(F.countDistinct("device").alias("devices"))
    shown = F.round("value", digits)
    conditions = F.concat_ws("|", F.coalesce(F.col("temperature").cast("int").cast("string"), F.lit("-")), F.coalesce(F.round(F.col("voltage") * 10).cast("int").cast("string"), F.lit("-")))
    d = df.groupBy("group_id", "param").agg(F.countDistinct(shown).alias("different"), F.count("value").alias("present"), F.countDistinct(conditions).alias("conditions"))
    return d.join(F.broadcast(n), "group_id").select("group_id", "param", (F.col("different") > 1).alias("values_differ"), (F.col("present") < F.col("devices")).alias("some_missing"), (F.col("conditions") > 1).alias("conditions_differ"))


def value_ranks(df: DataFrame) -> DataFrame:
    w = by_param().orderBy(F.desc_nulls_last("value"), "device")
    return df.select("group_id", "param", "device", F.row_number().over(w).alias("value_rank"))


def comparison_matrix(df: DataFrame, params: list[str]) -> DataFrame:
    """Devices as rows, the listed parameters as columns."""
    return df.groupBy("group_id", "device").pivot("param", params).agg(F.max("value"))


#: Which scoring parameter an electrical one stands for, in order; a later one replaces an earlier.
SCORING_NAMES = [
    ("VCC", "supply_voltage"), ("VDD", "supply_voltage"), ("VOH", "output_voltage_high"), ("VOL", "output_voltage_low"),
    ("VIH", "input_voltage_high"), ("VIL", "input_voltage_low"), ("IOH", "output_current"), ("IOL", "output_current"),
    ("IIH", "input_current"), ("IIL", "input_current"), ("ICC", "quiescent_current"), ("IDD", "quiescent_current"),
    ("tPLH", "propagation_delay"), ("tPHL", "propagation_delay"), ("tpd", "propagation_delay"), ("fmax", "frequency"),
    ("Frequency", "frequency"), ("Temperature", "temperature_range"),
]


def scoring_parameters(df: DataFrame) -> DataFrame:
    """``chip, param, value, source, confidence`` under scoring names, with derived and default rows."""
    names = F.broadcast(df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(SCORING_NAMES)], "_no int, _from string, _to string"))
    d = df.join(names, F.lower("param") == F.lower("_from"), "left")
    d = d.withColumns({"param": F.coalesce("_to", F.lower("param")), "_no": F.coalesce("_no", F.lit(-1))})
    own = d.where("value is not null").groupBy("chip", "param").agg(F.max_by(F.struct("value", "source", "confidence"), F.struct("_no", "confidence", "value", "source")).alias("s")).select("chip", "param", "s.*")
    has = lambda p, c="value": F.max(F.when(F.col("param") == p, F.col(c)))
    chip = own.groupBy("chip").agg(has("quiescent_current").alias("iq"), has("supply_voltage").alias("v"))
    power = F.when(F.col("iq") != 0, F.abs("iq") * F.coalesce("v", F.lit(5.0)) / 1000)
    ttl = F.upper("chip").rlike("HCT|TTL").cast("double")
    row = lambda p, v, s, c: F.struct(F.lit(p).alias("param"), v.alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    derived = chip.select("chip", F.inline(F.array(row("power_consumption", power, "llm_inference", 0.7), row("temperature_range", F.lit(85.0), "default_value", 0.3), row("package_size", F.lit(14.0), "default_value", 0.3), row("ttl_compatible", ttl, "rule_inference", 0.7)))).where("value is not null")
    return own.unionByName(derived.join(own, ["chip", "param"], "left_anti"))


def position_clusters(df: DataFrame, by: str, position: str, bucket: float = 50.0, gap: float = 80.0, least: int = 3) -> DataFrame:
    """Gaps and islands on one axis: buckets are joined while they are at most ``gap`` apart.

    Groups of at most 5 members, and groups that would keep no cluster of ``least`` members, are one
    cluster.
    """
    key = Window.partitionBy(by)
    d = df.withColumns({"_b": F.floor(F.col(position) / bucket) * bucket, "_all": F.count("*").over(key)})
    order = key.orderBy("_b").rangeBetween(Window.unboundedPreceding, 0)
    buckets = d.groupBy(by, "_b").agg(F.first("_all").alias("_all"), F.count("*").alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    new = F.when(F.col("_b") - F.lag("_b").over(key.orderBy("_b")) > gap, 1).otherwise(0)
    c = buckets.withColumn("_new", new).withColumn("island", F.when(F.col("_all") <= 5, 0).otherwise(F.sum("_new").over(order)))
    c = c.groupBy(by, "island").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("_all").alias("_all"))
    some = F.max((F.col("n") >= least).cast("int")).over(key)
    c = c.withColumn("_some", some)
    kept = c.where((F.col("n") >= least) | (F.col("_all") <= 5))
    whole = c.where((F.col("_some") == 0) & (F.col("_all") > 5)).groupBy(by).agg(F.lit(0).alias("island"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return kept.select(by, "island", "n", "lo", "hi").unionByName(whole.select(by, F.col("island").cast("long"), "n", "lo", "hi"))
