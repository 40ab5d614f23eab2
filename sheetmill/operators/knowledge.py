"""Chips, their parameters, and values merged from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmill.operators.retrieval import containing, top_k

# makers' prefixes of part numbers.
PREFIXES = ("SN", "CD", "MC", "LM", "NE", "UA", "ULN", "TLC", "TIP", "IRF", "2N", "BC", "BD")
# Process families, in the order in which they are tried.
PROCESS_FAMILIES = [
    ("CMOS", ("STM32", "ESP32", "AVR", "74HC", "74HCT", "74LVC", "74LV", "74AHC", "74AHCT", "MSP430", "CH340", "W25Q", "LDO", "RESET", "OSCILLATOR")),
    ("BiCMOS", ("74ABT", "74BCT", "74FCT")),
    ("TTL", ("74LS", "74S", "74ALS", "74AS", "74F")),
    ("ECL", ("ECL",)),
]
# Lowest and highest believable voltage of a document, and its farthest distance from the knowledge base.
VOLTAGE_BOUNDS = {"VIH": (1.5, 4.0, 0.3), "VIL": (0.3, 1.5, 0.3), "VOH": (2.0, 5.0, 0.3), "VOL": (0.05, 1.5, 0.3)}
# Names under which the knowledge base may hold a parameter, the best first.
ALTERNATES = {
    "VOH": ["VOH", "output_voltage_high"],
    "VOL": ["VOL", "output_voltage_low"],
    "VIH": ["VIH", "input_voltage_high"],
    "VIL": ["VIL", "input_voltage_low"],
    "IOH": ["IOH", "output_current"],
    "IOL": ["IOL", "output_current"],
    "VCC": ["VCC", "supply_voltage"],
    "VDD": ["VDD", "VCC", "supply_voltage"],
    "fmax": ["fmax", "frequency", "Frequency"],
}


def normalised_name(name: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Upper case, without a maker's prefix where a digit follows."""
    return F.regexp_replace(F.upper(F.trim(name)), f"^(?:{'|'.join(sorted(prefixes, key=len, reverse=True))})([0-9])", "$1")


def process_of_family(family: Column) -> Column:
    f, out = F.upper(family), F.lit("CMOS")
    for process, marks in reversed(PROCESS_FAMILIES):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(f, F.lit(m))
        out = F.when(hit, process).otherwise(out)
    return out


def found_chips(names: DataFrame, chips: DataFrame, split: int = 8) -> DataFrame:
    """``query_id, chip_id, level``: exact names, else parts of (normalised) names, of the best level only.

    ``names(query_id, name)`` has one name of each query. Names are answered once, however many queries ask for
    them, and meet the different texts of chips only; queries and chips come in at the end. Exact matches are an
    equi join; only names without one look for parts of names, by their rarest grams. Names and chips grow with the
    corpus, however small their files look, and are not broadcast.
    """
    asked = names.where("name is not null").select("name").distinct()
    exact = asked.join(chips.select("chip_id", "name").hint("merge"), "name").select("name", "chip_id", F.lit(1).alias("level"))
    rest = asked.join(chips.select("name").hint("merge"), "name", "left_anti").withColumn("norm", normalised_name(F.col("name")))

    def held(needle: Column, text: str, level: int, asked: DataFrame = rest) -> DataFrame:
        n = asked.select("name", F.lower(needle).alias("needle"))
        hays = chips.select("chip_id", F.lower(text).alias("hay")).where("hay is not null")
        met = containing(n.select("needle").distinct(), hays.select("hay").distinct().select(F.col("hay").alias("row_id"), "hay"))
        return met.join(n.hint("merge"), "needle").select("name", F.col("row_id").alias("hay")).join(hays.hint("merge"), "hay").select("name", "chip_id", F.lit(level).alias("level"))

    second = held(F.col("norm"), "name", 2).unionByName(held(F.col("name"), "full_name", 2))
    third = held(F.col("norm"), "full_name", 3, rest.where(F.col("norm").startswith("74")))
    loose = second.unionByName(third).groupBy("name", "chip_id").agg(F.min("level").alias("level"))
    best = loose.withColumn("_m", F.min("level").over(Window.partitionBy("name"))).where("level = _m").drop("_m")
    # The chips of a name go to several tasks, and the queries that ask for it to each of them.
    dealt = exact.unionByName(best).withColumn("_part", F.pmod(F.xxhash64("chip_id"), F.lit(split)).cast("int"))
    queries = names.select("query_id", "name", F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("_part"))
    return queries.join(dealt.hint("merge"), ["name", "_part"]).select("query_id", "chip_id", "level")


def resolved_names(names: DataFrame, library: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, canonical, level``: exact, by alias, by the beginning of a name without its last digits, of an alias."""
    n = names.withColumn("norm", normalised_name(F.col("name")))
    exact = n.join(library.select("canonical", "position"), F.col("norm") == F.col("canonical")).select("query_id", "canonical", F.lit(1).alias("level"), "position")
    alias = n.join(aliases, F.col("norm") == F.col("alias")).select("query_id", "canonical", F.lit(2).alias("level"), F.lit(0).alias("position"))
    stem = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    # Beginnings of the names that nothing has resolved, joined with the stems they may equal.
    rest = n.join(exact.select("query_id").union(alias.select("query_id")).distinct(), "query_id", "left_anti")
    begins = rest.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("norm")), lambda k: F.substring("norm", F.lit(1), k))).alias("stem")).where(F.col("stem") != "")
    loose = begins.join(library.select("canonical", "position", stem("canonical").alias("stem")), "stem").select("query_id", "canonical", F.lit(3).alias("level"), "position")
    return top_k(exact.unionByName(alias).unionByName(loose), 1, "query_id", F.col("level"), F.col("position"), F.col("canonical")).drop("rank", "position")


def chip_parameters(chips: DataFrame, parameters: DataFrame, least: float = 0.0) -> DataFrame:
    return chips.join(parameters.where(F.col("confidence") >= least), "chip_id")


def best_values(parameters: DataFrame) -> DataFrame:
    """Of each chip and parameter the value of most confidence."""
    w = Window.partitionBy("chip_id", "param_name").orderBy(F.desc("confidence"), "param_id")
    return parameters.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_alternates(asked: DataFrame, parameters: DataFrame, alternates: dict[str, list[str]] = ALTERNATES) -> DataFrame:
    """``chip_id, param, value``: of the alternates that a chip has, the first."""
    rows = [(p, name, k) for p, names in alternates.items() for k, name in enumerate(names)]
    table = F.broadcast(asked.sparkSession.createDataFrame(rows, "param string, param_name string, prio int"))
    return asked.join(table, "param").join(parameters, "param_name").groupBy("chip_id", "param").agg(F.min_by("param_value", F.struct("prio", "param_id")).alias("value"), F.min("prio").alias("prio"))


def sane_values(df: DataFrame) -> DataFrame:
    """Impossible levels go; a high output current is negative, a low one positive."""
    p, v = F.col("param_name"), F.col("param_value")
    bad = (p.isin("VOH", "VIH") & (v < 0.5)) | (p.isin("VOL", "VIL") & (v > 5))
    return df.where(~bad).withColumn("param_value", F.when(p == "IOH", -F.abs(v)).when(p == "IOL", F.abs(v)).otherwise(v))


def milliamps(value: Column, unit: Column) -> Column:
    """A current as mA; without a unit its size tells."""
    u, a = F.lower(F.trim(unit)), F.abs(value)
    guess = F.when(a > 0.5, value).when(a > 0.001, value * 1000).otherwise(value * 1000000)
    return F.when(F.coalesce(u, F.lit("")) == "", guess).when(u.isin("ua", "µa", "μa"), value / 1000.0).when(u == "a", value * 1000.0).otherwise(value)


def suspicious(param: Column, doc: Column, doc_unit: Column, kb: Column, kb_unit: Column) -> Column:
    """Whether a document's value is not to be believed against the knowledge base's."""
    out = F.abs(doc - kb) > F.greatest(F.abs(kb) * 0.1, F.lit(0.0001))
    d, k = milliamps(doc, doc_unit), milliamps(kb, kb_unit)
    ratio = F.abs(d) / F.nullif(F.abs(k), F.lit(0.0))
    off = F.coalesce((d != 0) & ((ratio > 10) | (ratio < 0.1)), F.lit(False))
    out = F.when(param.isin("IOH", "IOL"), (F.abs(d) > 1000) | (F.abs(d) < 0.1) | off).when(param.isin("IIH", "IIL"), (F.abs(d) > 0.1) | off | (F.abs(d - k) > 0.01)).otherwise(out)
    for name, (low, high, far) in VOLTAGE_BOUNDS.items():
        out = F.when(param == name, (doc < low) | (doc > high) | (F.abs(doc - kb) > far)).otherwise(out)
    return out


def checked_merge(doc: DataFrame, kb: DataFrame) -> DataFrame:
    """Document values, but the knowledge base's where there is none or it is suspicious."""
    j = doc.join(kb, ["chip_id", "param_name"], "full_outer")
    none = F.lit(None).cast("string")
    bad = F.coalesce(suspicious(F.col("param_name"), F.col("doc_value"), F.col("unit"), F.col("kb_value"), none), F.lit(False))
    use_kb = F.col("doc_value").isNull() | (bad & F.col("kb_value").isNotNull())
    return j.select("chip_id", "param_name", F.when(use_kb, F.col("kb_value")).otherwise(F.col("doc_value")).alias("value"), F.when(use_kb, "knowledge_graph").otherwise("document").alias("origin"))


def staged_merge(stages: list[DataFrame], gate: int | None = None) -> DataFrame:
    """Of each chip and parameter the value of the first stage that has it.

    With ``gate``, later stages are asked only for chips of which the first has fewer parameters.
    """
    tagged = [s.select("chip_id", "param_name", "value", F.lit(k).alias("stage")) for k, s in enumerate(stages)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    if gate is not None:
        u = u.withColumn("_have", F.count(F.when(F.col("stage") == 0, 1)).over(Window.partitionBy("chip_id"))).where((F.col("stage") == 0) | (F.col("_have") < gate)).drop("_have")
    w = Window.partitionBy("chip_id", "param_name").orderBy("stage", "value")
    return u.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def completeness(chips: DataFrame, values: DataFrame, required: list[str]) -> DataFrame:
    """Each chip: required parameters that are there, missing ones, the share, mean confidence."""
    need = chips.select("chip_id", F.explode(F.array(*(F.lit(p) for p in required))).alias("param_name"))
    j = need.join(values, ["chip_id", "param_name"], "left")
    have = F.col("param_value").isNotNull()
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("param_name")))), ",")
    return j.groupBy("chip_id").agg(listed(have).alias("available"), listed(~have).alias("missing"), (F.count_if(have) / F.count("*")).alias("ratio"), F.avg("confidence").alias("confidence"))


def flattened_chips(chips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested chip records (``name, family, process, pins, parameters map``) as chips, pins and parameters.

    The last of records with a name replaces the others; parameters come from the knowledge base at
    confidence 0.8, under ``{chip}_{param}``.
    """
    last = top_k(chips, 1, "name", F.desc("record")).drop("rank")
    c = last.select(F.col("name").alias("chip_id"), "name", "family", F.coalesce("process", process_of_family(F.col("family"))).alias("process"), F.size("pins").alias("pin_count"))
    pins = last.select(F.col("name").alias("chip_id"), F.inline("pins"))
    params = last.select(F.col("name").alias("chip_id"), F.explode(F.map_entries("parameters")).alias("e")).select("chip_id", F.concat_ws("_", "chip_id", "e.key").alias("param_id"), F.col("e.key").alias("param_name"), F.col("e.value").alias("param_value"), F.lit("knowledge_graph").alias("source"), F.lit(0.8).alias("confidence"))
    return c, pins, params


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out
