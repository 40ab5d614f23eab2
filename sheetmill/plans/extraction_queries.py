"""Queries that extract parameters, part numbers and pins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sheetmill.functions import values
from sheetmill.operators import extraction as X
from sheetmill.operators import tables as T
from sheetmill.plans import table_queries as G
from sheetmill.plans.fixtures import read
from sheetmill.plans.sql_parts import keywords

PARAMS = ["VOH", "VOL", "VIH", "VIL", "IOH", "IOL", "VCC"]


def _texts(spark, sf_dir):
    """One line for each parameter of a chip, as data sheets print them."""
    p = read(spark, sf_dir, "fx_parameter_texts")
    unit = F.when(F.col("param_name").startswith("V"), "V").otherwise("mA")
    line = F.concat(F.col("param_name"), F.when(F.col("confidence") > 0.55, F.lit(" = ")).otherwise(F.lit("  typical at 25  ")), F.col("value_text"), F.lit(" "), unit)
    return p.groupBy(F.col("chip_id").alias("chip")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def _responses(spark, sf_dir):
    """One line for each parameter of a chip, as a model answers when asked for it."""
    p = read(spark, sf_dir, "fx_parameter_texts")
    r = p.select("chip_id", F.concat("param_name", F.lit(": "), F.col("value_text"), F.lit(" V [25C]")).alias("line"))
    return r.groupBy(F.col("chip_id").alias("chip")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("response"))


def ex1(spark, sf_dir):
    """Tables of a few chips, texts of the rest, answers for what neither has."""
    number = F.col("table_id").cast("string")
    chip = F.concat(F.lit("chip"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0")))
    chips = read(spark, sf_dir, "fx_chips").select(F.col("chip_id").alias("chip"))
    # Most tables belong to no chip, and are not parsed.
    grids = G.grids(spark, sf_dir).withColumn("chip", chip).join(chips.hint("merge"), "chip", "left_semi")
    tables = T.table_specs(grids, PARAMS).select(chip.alias("chip"), "param", "value", "confidence")
    answers = _responses(spark, sf_dir)
    wanted = chips.select("chip", F.explode(F.array(*map(F.lit, PARAMS))).alias("param"))
    stages = [X.stage_of_tables(tables), X.stage_of_texts(_texts(spark, sf_dir), PARAMS), X.stage_of_responses(lambda asked: asked.join(answers.hint("merge"), "chip"), PARAMS)]
    return X.cascade(wanted, stages)


def ex2(spark, sf_dir):
    return X.regex_specs(_texts(spark, sf_dir), PARAMS)


def ex3(spark, sf_dir):
    return X.line_specs(_responses(spark, sf_dir), PARAMS)


def ex4(spark, sf_dir):
    temperature, voltage = X.conditions(F.col("condition_text"))
    return read(spark, sf_dir, "fx_tables").select("table_id", "row_no", temperature.alias("temperature"), voltage.alias("voltage"))


def ex5(spark, sf_dir):
    n = read(spark, sf_dir, "fx_names")
    return n.select("query_id", F.array_join(F.array_sort(X.part_numbers(F.concat(F.lit("compare "), "name", F.lit(" with lm358 and LM358")))), ",").alias("parts"))


def ex6(spark, sf_dir):
    n = read(spark, sf_dir, "fx_names")
    return n.select("query_id", F.array_join(X.driver_and_receiver(F.concat(F.lit("can SN74HC04 drive 74HC04 or "), "name", F.lit("?"))), ">").alias("pair"))


def ex7(spark, sf_dir):
    return _texts(spark, sf_dir).select("chip", X.section_values(F.col("text"), F.lit("voltage")).alias("values"))


def ex8(spark, sf_dir):
    c = read(spark, sf_dir, "fx_chips")
    t = F.array_join(F.transform(F.sequence(F.lit(1), F.col("pin_count")), lambda i: F.concat(F.lit("Pin "), i, F.lit(": "), F.when(i == 1, "GND").when(i == 2, "VCC").when(i % 3 == 0, F.concat(F.lit("IN"), i)).otherwise(F.concat(F.lit("OUT"), i)))), "\n")
    return X.pins_of_hits(c.select(F.col("chip_id").alias("query_id"), F.lit(1).alias("rank"), t.alias("text"), "package"))


def ex13(spark, sf_dir):
    lib = read(spark, sf_dir, "fx_chips").select(F.col("chip_id").alias("query_id"), F.col("pin_count").alias("library_pins"))
    return X.pin_decisions(ex8(spark, sf_dir), lib)


def ex9(spark, sf_dir):
    c = read(spark, sf_dir, "fx_chips")
    t = F.concat(F.lit("in a "), F.coalesce("package", F.lit("box")), F.lit(" or tssop-20 package"))
    return c.select("chip_id", X.package_of_text(t).alias("package"), X.most_pins(F.col("package")).alias("most_pins"))


#: What stands in texts where pins are named, and names that texts seldom hold.
PIN_WORD = "[A-Za-z0-9][A-Za-z0-9_+/-]{0,15}"
PIN_NAMES = ("VCC", "V+", "GND", "1OUT", "3O", "2IN+", "PA7", "GP12", "NRST", "N.C.", "AIN0", "JAN-2020", "REV", "V1.2", "SHEET 1/2", "FIGURE 7", "2024", " VDD ", "")


def ex11(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(PIN_WORD), F.lit(0))).alias("name"))
    n = words.union(spark.createDataFrame([(x,) for x in PIN_NAMES], "name string")).distinct()
    return n.select("name", X.pin_type(F.col("name")).alias("type"), X.is_garbage_pin(F.col("name")).alias("garbage"), X.is_meaningful_pin(F.col("name")).alias("meaningful"))


def ex15(spark, sf_dir):
    p = ex8(spark, sf_dir).select("query_id", F.when(F.col("pin") % 5 == 0, "x").otherwise(F.col("pin").cast("string")).alias("number"), "name", F.when(F.col("pin") % 7 == 0, "odd").otherwise(F.col("type")).alias("type"), F.array("name", F.lit("ALT")).alias("functions"))
    return X.valid_pins(p).groupBy("problem").agg(F.count("*").alias("n"), F.max(F.size("functions")).alias("functions"))


def rt16(spark, sf_dir):
    q = read(spark, sf_dir, "fx_figure_queries")
    return q.select("query_id", F.array_join(F.array_sort(X.query_keywords(F.concat("query", F.lit(" 低通滤波器, the 电路")))), ",").alias("keywords"))


def rt19(spark, sf_dir):
    return read(spark, sf_dir, "fx_figure_queries").select("query_id", X.enriched_query(F.col("query")).alias("query"))


def rt21(spark, sf_dir):
    n = read(spark, sf_dir, "fx_names")
    q = F.concat(F.lit("what "), F.when(F.col("query_id") % 2 == 0, F.lit("supply voltage ")).otherwise(F.lit("")), F.lit("has "), "name")
    return n.select("query_id", X.rewritten_query(q).alias("query"))


QUERIES = {
    "ex1_cascade": ex1, "ex2_regex_family": ex2, "ex3_line_format": ex3, "ex4_conditions": ex4, "ex5_part_numbers": ex5, "ex6_pairs": ex6, "ex7_section_values": ex7, "ex8_pins": ex8, "ex9_ex10_packages": ex9,
    "ex11_ex12_pin_names": ex11, "ex13_pin_decision": ex13, "ex15_pin_validation": ex15, "rt16_query_keywords": rt16, "rt19_query_enrichment": rt19, "rt21_query_rewrite": rt21,
}

_PINS = "SELECT chip_id AS query_id, pin, CASE WHEN pin = 1 THEN 'GND' WHEN pin = 2 THEN 'VCC' WHEN pin % 3 = 0 THEN concat('IN', pin) ELSE concat('OUT', pin) END AS name, package FROM (SELECT chip_id, package, unnest(range(1, pin_count + 1)) AS pin FROM {fx_chips}) WHERE pin <= CASE WHEN package IS NULL THEN 128 ELSE CAST(regexp_extract(package, '([0-9]+)', 1) AS INTEGER) END"

def _family() -> str:
    """Of each parameter's patterns the first with a value in range, as SQL."""
    rows = []
    for p in PARAMS:
        low, high = T.RANGES[p]
        tries = "".join(f" UNION ALL SELECT chip, '{p}' AS param, {k} AS k, TRY_CAST(regexp_extract(text, '(?i){x}', 1) AS DOUBLE) AS value, {low} AS lo, {high} AS hi FROM t" for k, x in enumerate(values.PARAMETER_PATTERNS[p]))
        rows.append(tries)
    return f"""WITH l AS (SELECT chip_id AS chip, concat(param_name, CASE WHEN confidence > 0.55 THEN ' = ' ELSE '  typical at 25  ' END, value_text, ' ', CASE WHEN param_name LIKE 'V%' THEN 'V' ELSE 'mA' END) AS line FROM {{fx_parameter_texts}}),
t AS (SELECT chip, array_to_string(list(line ORDER BY line), chr(10)) AS text FROM l GROUP BY chip), f AS ({"".join(rows)[len(" UNION ALL "):]}),
x AS (SELECT chip, param, value, round(0.85 - 0.04 * k, 2) AS confidence, row_number() OVER (PARTITION BY chip, param ORDER BY k) AS n FROM f WHERE value BETWEEN lo AND hi), rx AS (SELECT chip, param, value, CAST(confidence AS DOUBLE) AS confidence FROM x WHERE n = 1)"""


_LINES = """WITH r AS (SELECT chip_id AS chip, param_name AS param, value_text AS v FROM {fx_parameter_texts}),
f AS (SELECT *, row_number() OVER (PARTITION BY chip, param ORDER BY concat(param, ': ', v)) AS n FROM r)"""

_TEXTS = """WITH l AS (SELECT chip_id AS chip, concat(param_name, CASE WHEN confidence > 0.55 THEN ' = ' ELSE '  typical at 25  ' END, value_text, ' ', CASE WHEN param_name LIKE 'V%' THEN 'V' ELSE 'mA' END) AS line FROM {fx_parameter_texts}),
t AS (SELECT chip, array_to_string(list(line ORDER BY line), chr(10)) AS text FROM l GROUP BY chip)"""


def _pin_names() -> str:
    """Kind and standing of each name by the same tables, as SQL."""
    low, up = "lower(trim(name))", "upper(trim(name))"
    quoted = lambda w: w.replace("'", "''")
    # A repetition is written with both bounds, as names in braces stand for tables.
    found = lambda p: f"regexp_matches({up}, '{re.sub(r'[{]([0-9]+)[}]', r'{\1,\1}', p)}')"
    any_of = lambda words, patterns: " OR ".join([f"contains({low}, '{quoted(w)}')" for w in words] + [found(p) for p in patterns])
    kinds = " ".join(f"WHEN {any_of(words, patterns)} THEN '{kind}'" for kind, words, patterns in values.PIN_KINDS)
    months = ", ".join(f"'{m}'" for m in values.MONTHS)
    begins = " OR ".join(f"starts_with({up}, '{p}')" for p in values.MEANINGFUL_PREFIXES)
    extra = ", ".join(f"'{x}'" for x in PIN_NAMES)
    return f"""WITH n AS (SELECT unnest(regexp_extract_all(text, '{PIN_WORD}')) AS name FROM {{documents}} UNION SELECT unnest([{extra}]) AS name)
SELECT name, CASE {kinds} ELSE '{values.OTHER_PIN}' END AS type, {up} = '' OR (left({up}, 3) IN ({months}) AND ({any_of((), values.DATE_PATTERNS)})) OR {any_of((), values.GARBAGE_PATTERNS)} AS garbage,
{begins} OR {any_of(values.MEANINGFUL_WORDS, values.MEANINGFUL_PATTERNS)} AS meaningful FROM n"""


#: Each stage as a table of its own; a pair takes the first that has it.
_CASCADE = f"""WITH st AS (SELECT concat('chip', lpad(CAST(table_id AS VARCHAR), CAST(greatest(6, length(CAST(table_id AS VARCHAR))) AS INTEGER), '0')) AS chip, param, value, confidence, 1 AS stage FROM ({G.SQL["tb10_tb12_specs"]})
  UNION ALL SELECT chip, param, value, confidence, 2 FROM ({_family()} SELECT chip, param, value, confidence FROM rx) UNION ALL SELECT chip, param, value, confidence, 3 FROM (@lines@)),
w AS (SELECT chip_id AS chip, unnest([{', '.join(f"'{p}'" for p in PARAMS)}]) AS param FROM {{fx_chips}}),
r AS (SELECT st.*, row_number() OVER (PARTITION BY st.chip, st.param ORDER BY stage, confidence DESC, value) AS n FROM st JOIN w ON w.chip = st.chip AND w.param = st.param)
SELECT chip, param, value, confidence, stage FROM r WHERE n = 1"""

SQL = {
    "ex11_ex12_pin_names": _pin_names(),
    "ex5_part_numbers": "SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat('compare ', name, ' with lm358 and LM358'), '(?i)" + X.PART_NUMBER + "'), lambda x: upper(x)))), ',') AS parts FROM {fx_names}",
    "ex7_section_values": _TEXTS + " SELECT chip, array_to_string(list_slice(regexp_extract_all(text, '(?i)(?:VCC|VDD|VS|Supply\\s+voltage)[^\n]@0,40@?\\d+\\.?\\d*\\s*V'), 1, 3), '; ') AS values FROM t".replace("@0,40@", "{0,40}"),
    "ex15_pin_validation": f"WITH p AS (SELECT query_id, pin, name, CASE WHEN pin % 5 = 0 THEN 'number' WHEN pin % 7 = 0 THEN 'type' END AS problem FROM ({_PINS})) SELECT problem, count(*) AS n, 1 AS functions FROM p GROUP BY problem",
    "ex2_regex_family": _family() + " SELECT chip, param, value, confidence FROM rx",
    "ex3_line_format": _LINES + " SELECT chip, param, CAST(v AS DOUBLE) AS value, 'V' AS unit, '25C' AS condition, CAST(0.8 AS DOUBLE) AS confidence FROM f WHERE n = 1 AND " + "(" + " OR ".join(f"(param = '{p}' AND CAST(v AS DOUBLE) BETWEEN {T.RANGES[p][0]} AND {T.RANGES[p][1]})" for p in PARAMS) + ")",
    "rt16_query_keywords": "WITH a AS (SELECT query_id, concat(query, ' 低通滤波器, the 电路') AS query FROM {fx_figure_queries}), " + keywords("a", "w") + " SELECT query_id, array_to_string(list_sort(words), ',') AS keywords FROM w",
    "ex4_conditions": "SELECT table_id, row_no, CAST(25 AS DOUBLE) AS temperature, CAST(regexp_extract(condition_text, 'VCC = ([0-9]+)', 1) AS DOUBLE) AS voltage FROM {fx_tables}",
    "ex8_pins": f"SELECT query_id, CAST(pin AS INTEGER) AS pin, name, CASE WHEN name = 'GND' THEN 'ground' WHEN name = 'VCC' THEN 'power' WHEN name LIKE 'IN%' THEN 'input' ELSE 'output' END AS type FROM ({_PINS})",
    "ex9_ex10_packages": "SELECT chip_id, CASE WHEN package LIKE 'DIP%' THEN package ELSE 'TSSOP-20' END AS package, CASE WHEN package IS NULL THEN 128 ELSE CAST(regexp_extract(package, '([0-9]+)', 1) AS INTEGER) END AS most_pins FROM {fx_chips}",
    "ex13_pin_decision": f"WITH p AS ({_PINS}), g AS (SELECT query_id, count(*) AS n FROM p GROUP BY query_id) SELECT chip_id AS query_id, n, CASE WHEN CAST(n AS DOUBLE) / pin_count < 0.8 THEN 'library' ELSE 'extracted' END AS source FROM {{fx_chips}} JOIN g ON query_id = chip_id",
    "rt21_query_rewrite": r"""WITH q AS (SELECT query_id, name, concat('what ', CASE WHEN query_id % 2 = 0 THEN 'supply voltage ' ELSE '' END, 'has ', name) AS q FROM {fx_names}), c AS (SELECT *, upper(regexp_extract(q, '(?i)\b([A-Z]{2,}\d+[A-Z0-9-]*|SN\d+[A-Z]+\d*|NE\d+|LM\d+|CD\d+[A-Z]*)\b', 1)) AS chip FROM q)
SELECT query_id, CASE WHEN chip = '' THEN q WHEN query_id % 2 = 0 THEN concat(chip, ' voltage supply') ELSE concat(chip, ' supply voltage operating voltage') END AS query FROM c""",
}
SQL["ex1_cascade"] = _CASCADE.replace("@lines@", SQL["ex3_line_format"])
