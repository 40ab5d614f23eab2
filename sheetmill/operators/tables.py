"""Extracted tables: ``table_id, document_id, page, data array<array<string>>`` with the header in row 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmill.functions import values
from sheetmill.functions.folds import bound

# Patterns of table types over the header and the first column.
TYPE_PATTERNS = [
    ("electrical_characteristics", r"electrical\s*characteristics|dc\s*characteristics|ac\s*characteristics|recommended\s*operating"),
    ("pin_configuration", r"pin\s*configuration|pin\s*description|pinout|pin-out"),
    ("absolute_maximum", r"absolute\s*maximum"),
    ("timing", r"timing\s*characteristics|switching\s*characteristics"),
    ("package_dimensions", r"package\s*(information|dimensions|outline)"),
]
# Words of package drawings.
PACKAGE_WORDS = ["seating plane", "package dimensions", "mechanical data", "package information", "outline", "drawing", "mm", "[", "]", "typ", "pin 1 id area", "mechanical", "package", "dimensions (mm)", "inches", "millimeters"]
# Header words by category.
HEADER_WORDS = [
    ("parameter", ["parameter", "symbol", "param", "characteristic", "参数", "符号"]),
    ("value", ["min", "max", "typ", "typical", "minimum", "maximum", "最小", "最大", "典型"]),
    ("unit", ["unit", "units", "单位"]),
    ("condition", ["condition", "test condition", "note", "条件", "测试条件"]),
    ("pin", ["pin", "pinout", "引脚", "管脚"]),
    ("description", ["description", "function", "描述", "功能"]),
]
# Header words by column role.
ROLE_WORDS = [
    ("symbol", ["symbol", "parameter", "param", "sym", "符号", "参数名", "参数符号", "characteristic", "characteristics"]),
    ("min", ["min", "minimum", "最小", "min."]),
    ("typ", ["typ", "typical", "nom", "nominal", "典型", "typ."]),
    ("max", ["max", "maximum", "最大", "max."]),
    ("unit", ["unit", "units", "单位", "un"]),
    ("cond", ["condition", "test condition", "note", "条件", "测试条件", "conditions", "notes", "remarks"]),
]
# Believable range of each parameter.
RANGES = {"VOH": (0.5, 25.0), "VOL": (0.0, 3.0), "VIH": (0.5, 25.0), "VIL": (0.0, 5.0), "VCC": (1.0, 50.0), "VDD": (1.0, 50.0), "IOH": (-500.0, 500.0), "IOL": (0.01, 500.0), "IIH": (-500.0, 500.0), "IIL": (-500.0, 500.0), "ICC": (0.0, 1000.0), "IDD": (0.0, 1000.0)}
MIN_CLASS, MAX_CLASS = ("VOH", "VIH", "IOH"), ("VOL", "VIL", "IOL", "TPD", "TPLH", "TPHL", "ICC", "IDD", "IIH", "IIL")


def _words(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(_words(words), lambda w: F.contains(text, w))


def stored(df: DataFrame) -> DataFrame:
    """``df`` with header, content, counts of rows, columns and empty cells."""
    cell = F.transform("data", lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    d = df.withColumn("data", cell)
    flat = F.flatten("data")
    return d.withColumns({"header": F.try_element_at("data", F.lit(1)), "content": F.array_join(F.filter(flat, lambda c: c != ""), " "), "row_count": F.size("data"), "column_count": F.size(F.try_element_at("data", F.lit(1))), "empty_cells": F.size(F.filter(flat, lambda c: c == ""))})


def base_confidence(df: DataFrame) -> DataFrame:
    cells = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    return df.withColumn("confidence", 0.75 * (1 - F.col("empty_cells") / cells * 0.5))


def classified(df: DataFrame) -> DataFrame:
    """``table_type``: package drawings first (confidence at most 0.3), then patterns, then header words."""
    header = F.lower(F.array_join("header", " "))
    first = F.lower(F.array_join(F.transform(F.slice("data", 2, 4), lambda r: F.try_element_at(r, F.lit(1))), " "))
    both = F.concat_ws(" ", header, first)
    d = df.withColumns({"_h": header, "_b": both})
    kind = F.when(contains_any(F.col("_h"), ["pin", "symbol", "description"]), "pin_configuration").when(contains_any(F.col("_h"), ["parameter", "min", "max", "typ"]), "electrical_characteristics").otherwise("unknown")
    for name, pattern in reversed(TYPE_PATTERNS):
        kind = F.when(F.col("_b").rlike(pattern), name).otherwise(kind)
    drawing = contains_any(F.col("_b"), PACKAGE_WORDS)
    return d.withColumns({"table_type": F.when(drawing, "package_dimensions").otherwise(kind), "confidence": F.when(drawing, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))}).drop("_h", "_b")


def header_tagged(df: DataFrame) -> DataFrame:
    """``header_keywords`` as ``category:word``; any of them adds 0.05 to the confidence."""

    def tags(cell: Column) -> Column:
        found = [F.concat(F.lit(f"{cat}:"), F.try_element_at(F.filter(_words(ws), lambda w: F.contains(F.lower(F.trim(cell)), w)), F.lit(1))) for cat, ws in HEADER_WORDS]
        return F.array_compact(F.array(*found))

    d = df.withColumn("header_keywords", F.flatten(F.transform("header", tags)))
    return d.withColumn("confidence", F.when(F.size("header_keywords") > 0, F.least(F.col("confidence") + 0.05, F.lit(1.0))).otherwise(F.col("confidence")))


def quality_scored(df: DataFrame) -> DataFrame:
    fill = 1 - F.col("empty_cells") / F.nullif(F.col("row_count") * F.col("column_count"), F.lit(0))
    score = fill * 0.4 + F.when(F.size("header_keywords") > 0, 1.0).otherwise(0.5) * 0.3 + F.col("confidence") * 0.2 + F.when(F.col("table_type") != "unknown", 0.1).otherwise(0.0)
    return df.withColumn("confidence", F.coalesce(F.least(score, F.lit(1.0)), F.col("confidence")))


def merged_across_pages(df: DataFrame) -> DataFrame:
    """Tables that go on on the next or the last page, in one: the header once, the greatest confidence.

    A table's anchor is the first table of its document that it continues, as a star around it.
    """
    key = ["document_id", "table_type"]
    lower = F.array_distinct(F.transform("header", F.lower))
    t = df.where("table_type <> 'unknown'").select("table_id", *key, "page", "column_count", lower.alias("h"))
    o = t.select(F.col("table_id").alias("anchor"), *key, F.col("page").alias("p2"), F.col("column_count").alias("c2"), F.col("h").alias("h2"))
    alike = F.size(F.array_intersect("h", "h2")) / F.greatest(F.size(F.array_union("h", "h2")), F.lit(1))
    pairs = t.join(o, key).where((F.col("anchor") < F.col("table_id")) & (F.abs(F.col("page") - F.col("p2")) == 1) & (F.abs(F.col("column_count") - F.col("c2")) <= 1) & (alike > 0.7))
    first = pairs.groupBy("table_id").agg(F.min("anchor").alias("anchor"))
    # An anchor that itself continues another table is no star of its own.
    stars = first.join(first.select(F.col("table_id").alias("anchor")), "anchor", "left_anti")
    d = df.join(stars, "table_id", "left").withColumn("group_id", F.coalesce("anchor", "table_id"))
    parts = F.array_sort(F.collect_list(F.struct("page", "table_id", "data", "confidence")))
    g = d.groupBy("group_id", "document_id").agg(parts.alias("parts"), F.max("confidence").alias("confidence"), F.min("page").alias("page"), F.count("*").alias("n_tables"), F.min("table_type").alias("table_type"))
    body = F.concat(F.slice(F.col("parts")[0]["data"], 1, 1), F.flatten(F.transform("parts", lambda p: F.filter(p["data"], lambda r, i: i > 0))))
    return g.select(F.col("group_id").alias("table_id"), "document_id", "page", body.alias("data"), "confidence", "table_type", "n_tables", (F.col("n_tables") > 1).alias("is_cross_page"))


def pin_gap_penalty(df: DataFrame) -> DataFrame:
    """Confidence of pin tables, lowered by the share of gaps between their pin numbers."""
    pins = df.where("table_type = 'pin_configuration'").select("table_id", F.explode(F.filter(F.transform(F.slice("data", F.lit(2), F.greatest(F.size("data") - 1, F.lit(0))), lambda r: F.when(F.trim(F.try_element_at(r, F.lit(1))).rlike(r"^\d{1,9}$"), F.trim(F.try_element_at(r, F.lit(1))).cast("int"))), lambda x: x.isNotNull())).alias("pin"))
    gaps = pins.withColumn("gap", (F.col("pin") - F.lag("pin").over(Window.partitionBy("table_id").orderBy("pin")) > 1).cast("int")).groupBy("table_id").agg((F.coalesce(F.sum("gap"), F.lit(0)) / F.count("*")).alias("gap_share"))
    return df.join(gaps, "table_id", "left").withColumn("confidence", F.col("confidence") * (1 - F.coalesce("gap_share", F.lit(0.0)) * 0.5)).drop("gap_share")


def deduplicated(df: DataFrame) -> DataFrame:
    """Of tables of a document and page with equal sizes, first and last rows (20 signs of a cell), the first."""
    short = lambda r: F.transform(r, lambda c: F.substring(c, 1, 20))
    w = Window.partitionBy("document_id", "page", "column_count", "row_count", F.to_json(short(F.try_element_at("data", F.lit(1)))), F.to_json(short(F.try_element_at("data", F.lit(-1))))).orderBy("table_id")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def column_roles(header: Column) -> Column:
    """A struct of the column number (from 0) of each role; a cell takes the first role still free."""
    names = [n for n, _ in ROLE_WORDS]

    def roles_of(cell: Column, i: Column) -> Column:
        """All roles whose words the cell holds, with or without its blanks."""
        h = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
        found = lambda both: F.array_compact(F.array(*(F.when(both.rlike("|".join(w.replace(".", r"\.") for w in words)), n) for n, words in ROLE_WORDS)))
        return F.struct(bound(F.concat_ws("\n", h, F.regexp_replace(h, r"\s+", "")), found).alias("roles"), i.alias("i"))

    def take(taken: Column, cell: Column) -> Column:
        free = F.try_element_at(F.filter(cell["roles"], lambda r: ~F.exists(taken, lambda t: t["role"] == r)), F.lit(1))
        return bound(free, lambda f: F.when(f.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(f.alias("role"), cell["i"].alias("i"))))))

    pairs = F.transform(header, lambda c, i: F.struct(F.lower(F.concat(c, F.coalesce(F.get(header, i + 1), F.lit("")))).alias("c"), i.alias("i")))
    fallback = F.try_element_at(F.filter(pairs, lambda x: (x["i"] < F.size(header) - 1) & x["c"].rlike("|".join(ROLE_WORDS[0][1]))), F.lit(1))["i"]
    taken = F.aggregate(F.transform(header, roles_of), F.array().cast("array<struct<role:string,i:int>>"), take)

    def by_role(found: Column) -> Column:
        at = lambda n: F.try_element_at(F.filter(found, lambda t: t["role"] == n), F.lit(1))["i"]
        return F.struct(F.coalesce(at("symbol"), fallback).alias("symbol"), *(at(n).alias(n) for n in names[1:]))

    # As an argument of a function the roles taken are made once, not for each role anew.
    return F.get(F.transform(F.array(taken), by_role), F.lit(0))


def is_electrical(roles: Column) -> Column:
    return roles["symbol"].isNotNull() & F.coalesce(roles["min"], roles["typ"], roles["max"]).isNotNull()


def header_of(data: Column, rows: int = 10) -> Column:
    """``row_no, roles`` of the first of the first rows that reads like the header of an electrical table; null without one."""
    first = F.slice(F.transform(data, lambda r, i: F.struct(i.alias("row_no"), r.alias("cells"))), 1, rows)
    judged = lambda r: F.filter(F.array(F.struct(r["row_no"].alias("row_no"), column_roles(r["cells"]).alias("roles"))), lambda h: is_electrical(h["roles"]))
    none = F.array().cast("array<struct<row_no:int,roles:struct<" + ",".join(f"{n}:int" for n, _ in ROLE_WORDS) + ">>>")
    # Once a header is found, the rows below it are not looked at.
    return F.get(F.aggregate(first, none, lambda found, r: F.when(F.size(found) > 0, found).otherwise(judged(r))), F.lit(0))


def header_row(df: DataFrame, rows: int = 10) -> DataFrame:
    """``table_id, row_no, roles`` of each table that has a header."""
    return df.select("table_id", F.explode(F.array_compact(F.array(header_of(F.col("data"), rows)))).alias("head")).select("table_id", "head.*")


def parsed_number(text: Column) -> Column:
    """A cell's number: without its unit, the lower end of a range; null for blanks and dashes."""
    t = F.trim(text)
    clean = F.trim(F.regexp_replace(t, r"(?i)\s*[VmAµuμnpkMGHz°CF%Ωs]+$", ""))
    first = F.trim(F.element_at(F.split(clean, " to "), 1))
    return F.when(t.isin("-", "—", "–", "N/A", "n/a", "") | t.isNull(), None).otherwise(first.try_cast("double"))


def in_range(param: Column, value: Column, ranges: dict[str, tuple[float, float]] = RANGES) -> Column:
    """A believable value; an unknown parameter has any, null none."""
    out = value.isNotNull()
    for p, (low, high) in ranges.items():
        out = F.when(param == p, F.coalesce(value.between(low, high), F.lit(False))).otherwise(out)
    return out


def representative(param: Column, low: Column, typ: Column, high: Column) -> Column:
    p = F.upper(param)
    return F.when(p.isin(*MIN_CLASS), F.coalesce(low, typ, high)).when(p.isin(*MAX_CLASS), F.coalesce(high, typ, low)).otherwise(F.coalesce(typ, high, low))


def symbol_matches(symbol: Column, param: Column) -> Column:
    """Equal, or one in the other, without case, blanks, dashes and underscores."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"[\s_\-]", ""))
    return bound(norm(symbol), lambda a: bound(norm(param), lambda b: (a != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))))


def table_specs(df: DataFrame, params: list[str]) -> DataFrame:
    """``table_id, param, min_value, value, max_value, unit, condition``: the first believable row of each parameter."""
    heads = df.select("table_id", "data", F.explode(F.array_compact(F.array(header_of(F.col("data"))))).alias("head"))
    rows = heads.select("table_id", F.col("head.row_no").alias("head"), "head.roles", F.posexplode("data").alias("row_no", "cells")).where("row_no > head")
    cell = lambda n: F.get(F.col("cells"), F.col(f"roles.{n}"))
    low, typ, high = (parsed_number(cell(n)) for n in ("min", "typ", "max"))
    s = rows.select("table_id", "row_no", cell("symbol").alias("symbol"), low.alias("min_value"), typ.alias("typ"), high.alias("max_value"), cell("unit").alias("unit"), cell("cond").alias("condition"))
    s = s.withColumn("param", F.explode(F.filter(F.array(*(F.lit(p) for p in params)), lambda p: symbol_matches(F.col("symbol"), p))))
    s = s.withColumn("value", representative(F.col("param"), F.col("min_value"), F.col("typ"), F.col("max_value"))).where(in_range(F.col("param"), F.col("value")))
    first = s.groupBy("table_id", "param").agg(F.min_by(F.struct("min_value", "value", "max_value", "unit", "condition"), "row_no").alias("first"))
    return first.select("table_id", "param", "first.*", F.lit(0.93).alias("confidence"))


def scanned_text(df: DataFrame, params: list[str] | None = None, scan: dict[str, tuple] = values.TABLE_SCAN, text: str = "content") -> DataFrame:
    """``table_id, param, min_value, typ_value, max_value, unit, confidence`` out of flattened table text.

    Of a parameter's anchors the first with believable numbers in its window counts; a table that
    names neither the parameter nor a level is not scanned for it.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")
    d = df.select("table_id", clean.alias("_t"), F.upper(clean).alias("_u"))

    def row(v: Column, p: str, slots: tuple, unit: str) -> Column:
        first = -F.abs(F.get(v, F.lit(0))) if p == "IOH" else F.get(v, F.lit(0))
        # A maximum that is not there is the typical value.
        second = F.coalesce(F.get(v, F.lit(1)), first) if slots[-1] == "max" else F.get(v, F.lit(1))
        place = dict(zip(slots, (first, second)))
        null = F.lit(None).cast("double")
        return F.when(v.isNotNull(), F.struct(F.lit(p).alias("param"), *(place.get(s, null).alias(f"{s}_value") for s in ("min", "typ", "max")), F.lit(unit).alias("unit"), F.lit(0.85).alias("confidence")))

    rows = []
    for p in params or list(scan):
        anchors, before, after, inner, low, high, signed, slots, unit = scan[p]
        tries = []
        for anchor in anchors:
            at = F.instr(F.col("_u"), anchor)
            start = F.greatest(at - before, F.lit(1))
            window = F.substring("_t", start, at + after - start)
            if inner:
                mark, left, right = inner
                inside = F.instr(F.upper(window), mark)
                begin = F.greatest(inside - left, F.lit(1))
                window = F.when(inside > 0, F.substring(window, begin, inside + right - begin))
            found = F.transform(F.regexp_extract_all(window, F.lit(r"([+-]?\d+\.?\d*)" if signed else r"(\d+\.?\d*)"), F.lit(1)), lambda x: x.try_cast("double"))
            size = (lambda v: F.abs(v)) if p == "IOH" else (lambda v: v)
            good = F.filter(found, lambda v: size(v).between(low, high))
            tries.append(F.when(at > 0, bound(good, lambda g: F.when(F.size(g) > 0, g))))
        named = F.contains("_u", F.lit(p)) | F.contains("_u", F.lit("HIGH")) | F.contains("_u", F.lit("LOW"))

        # The numbers of a window are read once, and only where the row can come of them.
        rows.append(F.when(named, bound(F.coalesce(*tries), lambda v: row(v, p, slots, unit))))
    return d.select("table_id", F.inline(F.array_compact(F.array(*rows))))


def table_text(df: DataFrame) -> DataFrame:
    """``text``: cells that are not empty with bars, rows on lines; ``title``: six header cells, else the page."""
    line = lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | ")
    head = F.array_join(F.slice(F.filter("header", lambda c: c != ""), 1, 6), " | ")
    more = F.size(F.filter("header", lambda c: c != "")) > 6
    return df.withColumns({"text": F.array_join(F.filter(F.transform("data", line), lambda x: x != ""), "\n"), "title": F.when(head == "", F.concat(F.lit("Table p"), F.col("page"))).when(more, F.concat(head, F.lit(" ..."))).otherwise(head)})


def row_answers(queries: DataFrame, df: DataFrame, unit: str = r"[0-9]+(\.[0-9]+)?\s*(V|mA|A)") -> DataFrame:
    """Of each query (``query_id, document_id, word``) the first row of its document's first 10 tables with the word and a number."""
    few = df.withColumn("_t", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "table_id"))).where("_t <= 10")
    rows = few.select("document_id", "table_id", "_t", F.posexplode("data").alias("row_no", "cells")).withColumn("line", F.array_join("cells", " | ")).where(F.col("line").rlike(unit))
    hit = queries.join(rows, "document_id").where(F.contains(F.lower("line"), F.lower("word")))
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_t", "row_no"))).where("_n = 1").select("query_id", "table_id", "row_no", "line")
