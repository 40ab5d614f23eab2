"""Small dimension tables as DataFrames. They are defaults; every operator takes another in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetmill.functions import values

# Degradation of (process, package): temperature, humidity and voltage coefficients,
# base rate per 1000 h, activation energy, confidence interval.
DEGRADATION = [
    ("CMOS", "DIP", 0.002, 0.001, 0.001, 0.1, 0.7, 0.95, 1.05),
    ("CMOS", "SOP", 0.0025, 0.0015, 0.0012, 0.12, 0.7, 0.93, 1.07),
    ("CMOS", "QFP", 0.003, 0.002, 0.0015, 0.15, 0.7, 0.90, 1.10),
    ("CMOS", "BGA", 0.002, 0.001, 0.001, 0.08, 0.7, 0.96, 1.04),
    ("CMOS", "LGA", 0.0022, 0.0012, 0.0011, 0.09, 0.7, 0.95, 1.05),
    ("CMOS", "CSP", 0.0018, 0.0009, 0.0009, 0.07, 0.7, 0.97, 1.03),
    ("BiCMOS", "DIP", 0.0015, 0.0008, 0.0008, 0.08, 0.8, 0.97, 1.03),
    ("BiCMOS", "SOP", 0.0018, 0.001, 0.001, 0.09, 0.8, 0.95, 1.05),
    ("BiCMOS", "QFP", 0.002, 0.0012, 0.001, 0.1, 0.8, 0.94, 1.06),
    ("BiCMOS", "BGA", 0.0015, 0.0008, 0.0008, 0.07, 0.8, 0.97, 1.03),
    ("TTL", "DIP", 0.001, 0.0005, 0.0005, 0.05, 0.9, 0.98, 1.02),
    ("TTL", "SOP", 0.0012, 0.0006, 0.0006, 0.06, 0.9, 0.97, 1.03),
    ("NMOS", "DIP", 0.0025, 0.0015, 0.0015, 0.12, 0.65, 0.92, 1.08),
    ("NMOS", "QFP", 0.003, 0.002, 0.0018, 0.15, 0.65, 0.90, 1.10),
    ("PMOS", "DIP", 0.0028, 0.0018, 0.0016, 0.14, 0.62, 0.91, 1.09),
    ("ECL", "DIP", 0.0008, 0.0004, 0.0004, 0.04, 1.0, 0.98, 1.02),
    ("ECL", "QFP", 0.001, 0.0005, 0.0005, 0.05, 1.0, 0.97, 1.03),
    ("ECL", "BGA", 0.0007, 0.0003, 0.0003, 0.03, 1.0, 0.99, 1.01),
]
DEGRADATION_COLUMNS = "process string, package string, c_temp double, c_hum double, c_volt double, base_rate double, energy double, ci_low double, ci_high double"

# Parameter, coefficient, type, at another temperature than 25 degrees.
TEMPERATURE_COEFFICIENTS = [
    ("Rds_on", 1.4, "resistance"),
    ("propagation_delay", 1.2, "delay"),
    ("power_consumption", 1.3, "power"),
    ("quiescent_current", 1.25, "current"),
    ("input_current", 1.15, "current"),
    ("output_current", 0.95, "current"),
    ("frequency", 0.98, "frequency"),
]
# Parameter, coefficient at another voltage than 3.3.
VOLTAGE_COEFFICIENTS = [("propagation_delay", 0.9), ("power_consumption", 1.2), ("output_current", 1.1)]
# Source, reliability, spread of a value.
SOURCES = [
    ("datasheet_direct", 0.95, 0.05),
    ("datasheet_table", 0.90, 0.08),
    ("datasheet_graph", 0.75, 0.15),
    ("knowledge_graph", 0.65, 0.20),
    ("llm_inference", 0.50, 0.25),
    ("default_value", 0.30, 0.30),
]
# Parameter, kind, target, expected point, dimension.
PARAMETERS = [
    ("frequency", "benefit", None, 0.6, "performance"),
    ("propagation_delay", "cost", None, 0.6, "performance"),
    ("supply_voltage", "target", 3.3, 0.6, "usability"),
    ("output_current", "benefit", None, 0.6, "performance"),
    ("input_voltage_high", "cost", None, 0.6, None),
    ("input_voltage_low", "benefit", None, 0.6, None),
    ("power_consumption", "cost", None, 0.6, "power"),
    ("temperature_range", "benefit", None, 0.6, "reliability"),
    ("package_size", "cost", None, 0.6, "usability"),
    ("ttl_compatible", "benefit", None, 0.6, "reliability"),
    ("input_current", "cost", None, 0.6, "power"),
    ("quiescent_current", "cost", None, 0.6, "power"),
]
DIMENSIONS = ("performance", "power", "reliability", "usability")
# Interfaces that fit each other if one side adapts.
CONDITIONAL_INTERFACES = [("SPI", "GPIO"), ("GPIO", "SPI"), ("I2C", "GPIO"), ("GPIO", "I2C"), ("UART", "GPIO"), ("GPIO", "UART"), ("PWM", "GPIO"), ("GPIO", "PWM")]
EXACT_INTERFACES = ("GPIO", "UART", "I2C", "SPI", "ADC", "PWM", "CAN")


def degradation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEGRADATION, DEGRADATION_COLUMNS)


def temperature_coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPERATURE_COEFFICIENTS, "param string, t_coeff double, t_type string")


def voltage_coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOLTAGE_COEFFICIENTS, "param string, v_coeff double")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, base_reliability double, base_spread double")


def parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(PARAMETERS)], "param_no int, param string, kind string, target double, esp double, dimension string")


def tag_words(spark: SparkSession, classes: list[tuple[str, list[str]]]) -> DataFrame:
    """A dictionary ``word, tag, tag_no`` for ``tagging.tagger``."""
    return spark.createDataFrame([(w, tag, k) for k, (tag, words) in enumerate(classes) for w in words], "word string, tag string, tag_no int")


def circuit_words(spark: SparkSession) -> DataFrame:
    return tag_words(spark, values.CIRCUIT_WORDS)


def caption_words(spark: SparkSession) -> DataFrame:
    return tag_words(spark, list(values.CAPTION_CLASS_WORDS.items()))


def chinese_words(spark: SparkSession) -> DataFrame:
    """A dictionary ``word, weight`` for ``tagging.segmenter``: the Chinese words of the library's tables, all alike."""
    from sheetmill.operators.retrieval import STOP_WORDS, SYNONYMS

    known = [*STOP_WORDS, *SYNONYMS, *(w for ws in SYNONYMS.values() for w in ws), *(w for _, ws in values.CIRCUIT_WORDS for w in ws), *(w for ws in values.CAPTION_CLASS_WORDS.values() for w in ws)]
    words = {w for w in known if all("\u4e00" <= c <= "\u9fa5" for c in w)}
    return spark.createDataFrame([(w, 1.0) for w in sorted(words)], "word string, weight double")


def values_sql(rows: list[tuple], names: str) -> str:
    """The rows as a SQL table expression, for the twins."""
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {names}"
