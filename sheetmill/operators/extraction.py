"""Parameters, part numbers and pins out of text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmill.functions import values
from sheetmill.operators.tables import in_range

_NUMBER = r"([+-]?\d+\.?\d*)"
PART_NUMBER = r"\b([A-Z]{2,}\d+[A-Z0-9-]*|SN\d+[A-Z]+\d*|NE\d+|LM\d+|CD\d+[A-Z]*)\b"


def regex_specs(texts: DataFrame, params: list[str], text: str = "text", key: str = "chip", patterns: dict[str, list[str]] = values.PARAMETER_PATTERNS, among: str | None = None) -> DataFrame:
    """``<key>, param, value, confidence``: of each parameter's patterns the first with a believable value.

    ``among`` names a column with the parameters that are asked of a text; the patterns of others are not run.
    """
    found = []
    for p in params:
        tries = [F.regexp_extract(text, "(?i)" + x, 1).try_cast("double") for x in patterns[p]]
        ok = [F.when(in_range(F.lit(p), v), F.struct(v.alias("value"), F.lit(round(0.85 - 0.04 * k, 2)).alias("confidence"))) for k, v in enumerate(tries)]
        best = F.coalesce(*ok) if among is None else F.when(F.array_contains(among, p), F.coalesce(*ok))
        found.append(F.when(best.isNotNull(), F.struct(F.lit(p).alias("param"), best["value"].alias("value"), best["confidence"].alias("confidence"))))
    return texts.select(key, F.inline(F.array_compact(F.array(*found))))


#: A stage of the cascade: from the pairs ``<key>, param`` that are still open to specs of them.
Stage = Callable[[DataFrame], DataFrame]


def cascade(wanted: DataFrame, stages: list[Stage], key: str = "chip") -> DataFrame:
    """Of each pair of ``wanted(<key>, param)`` the spec of the first stage that has one, the most confident of it.

    A stage is given the pairs that no stage before it has answered, and does not see more: what is answered
    early costs later stages nothing. Specs of other pairs that a stage gives all the same are left out.

    Answers are put beside the pairs, which grow with the corpus, however small their file looks: nothing here is
    broadcast, and the exchange of a stage's specs serves all that looks at them later.
    """
    got = wanted.select(key, "param").distinct().withColumn("_got", F.lit(None).cast("struct<c:double,value:double,stage:int>"))
    for k, stage in enumerate(stages, 1):
        specs = stage(got.where("_got is null").select(key, "param"))
        best = specs.groupBy(key, "param").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value", F.lit(k).alias("stage"))).alias("_new"))
        got = got.join(best.hint("merge"), [key, "param"], "left").select(key, "param", F.coalesce("_got", "_new").alias("_got"))
    return got.where("_got is not null").select(key, "param", "_got.value", (-F.col("_got.c")).alias("confidence"), "_got.stage")


def stage_of_tables(specs: DataFrame, key: str = "chip") -> Stage:
    """Specs that tables hold."""
    return lambda open_: specs.join(open_.hint("merge"), [key, "param"], "left_semi")


def stage_of_texts(texts: DataFrame, params: list[str], text: str = "text", key: str = "chip") -> Stage:
    """Patterns of the open parameters over the electrical section of the texts that have any."""
    from sheetmill.operators.text import section

    def run(open_: DataFrame) -> DataFrame:
        asked = open_.groupBy(key).agg(F.collect_set("param").alias("_open"))
        return regex_specs(texts.join(asked.hint("merge"), key).withColumn(text, section(F.col(text))), params, text, key, among="_open")

    return run


def stage_of_responses(responses: Callable[[DataFrame], DataFrame], params: list[str], key: str = "chip") -> Stage:
    """Lines of answers to what is open: ``responses`` turns ``<key>, asked`` (parameters) into ``<key>, response``."""

    def run(open_: DataFrame) -> DataFrame:
        asked = open_.groupBy(key).agg(F.array_sort(F.collect_set("param")).alias("asked"))
        return line_specs(responses(asked), params, key)

    return run


def line_specs(responses: DataFrame, params: list[str], key: str = "chip", text: str = "response") -> DataFrame:
    """Specs out of lines ``PARAM: value unit [condition]``."""
    rows = []
    for p in params:
        pattern = rf"(?i){p}\s*:\s*{_NUMBER}\s*([VmAµuμnpkMGHz°CF%Ωs]*)\s*(?:\[([^\]]*)\])?"
        v = F.regexp_extract(text, pattern, 1).try_cast("double")
        rows.append(F.when(in_range(F.lit(p), v), F.struct(F.lit(p).alias("param"), v.alias("value"), F.regexp_extract(text, pattern, 2).alias("unit"), F.trim(F.regexp_extract(text, pattern, 3)).alias("condition"), F.lit(0.8).alias("confidence"))))
    return responses.select(key, F.inline(F.array_compact(F.array(*rows))))


def conditions(text: Column) -> tuple[Column, Column]:
    """Temperature and voltage of a test condition, VCC before VDD."""
    num = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double")
    return num(r"(?i)(\d+)\s*C"), F.coalesce(num(r"(?i)VCC\s*=\s*([\d.]+)\s*V?"), num(r"(?i)VDD\s*=\s*([\d.]+)\s*V?"))


def part_numbers(text: Column) -> Column:
    """Part numbers in a text, upper case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + PART_NUMBER), F.lit(1)), F.upper))


def driver_and_receiver(text: Column) -> Column:
    """The first two part numbers of a text of which none ends with the other."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + values.PAIRED_PARTS), F.lit(1)), F.upper)
    none = F.array().cast("array<string>")
    kept = F.aggregate(found, none, lambda acc, x: F.when(F.exists(acc, lambda c: c.endswith(x) | x.endswith(c)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, 2)


def section_values(text: Column, intent: Column) -> Column:
    """Values of a section that answer a question about voltage, current, temperature or power."""
    def all_of(pattern: str) -> Column:
        return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), 1, 3), "; ")

    asked = [F.when(intent == kind, all_of(pattern)) for kind, pattern in values.SECTION_VALUES.items()]
    return F.coalesce(*asked, all_of(values.OTHER_SECTION_VALUE))


# -- pins -------------------------------------------------------------------------------------------
def package_of_text(text: Column) -> Column:
    """The first package family that a text names with a number of pins."""
    out = F.lit(None).cast("string")
    for p in reversed(values.PACKAGES):
        pattern = rf"(?i)\b({'(?:PD)?' if p == 'DIP' else ''}{p}-?\d+)\b"
        out = F.when(text.rlike(pattern), F.upper(F.regexp_extract(text, pattern, 1))).otherwise(out)
    return out


def most_pins(package: Column) -> Column:
    """How many pins a package has by its number; 48 if it says nothing, 128 without a package."""
    p = F.upper(F.regexp_replace(package, "[- ]", ""))
    n = lambda x: F.nullif(F.regexp_extract(p, x, 1), F.lit("")).try_cast("int")
    plain = n(r"(?:DIP|SOIC|TSSOP|MSOP|SSOP|SOP|LQFP|TQFP|QFP|QFN|DFN|WLCSP|BGA)(\d+)")
    sot, to = n(r"^SOT\d*?(\d)$"), F.greatest((n(r"TO(\d+)") % 10), F.lit(3))
    guess = F.coalesce(plain, F.greatest(sot, F.lit(3)), to, F.lit(48))
    return F.when(package.isNull() | (package == ""), 128).when(p == "QFN56", 57).otherwise(guess)


def _holds(text: Column, words: Sequence[str], patterns: Sequence[str], upper: Column) -> Column:
    """Whether a lower-case text holds one of the words, or its upper case matches one of the patterns."""
    tests = [F.contains(text, F.lit(w)) for w in words] + [upper.rlike(p) for p in patterns]
    return reduce(Column.__or__, tests, F.lit(False))


def pin_type(name: Column, kinds: list[tuple[str, Sequence[str], Sequence[str]]] = values.PIN_KINDS) -> Column:
    """What a pin is for: the first kind of which the name holds a word or matches a pattern."""
    low, up = F.lower(F.trim(name)), F.upper(F.trim(name))
    tagged = [F.when(_holds(low, words, patterns, up), F.lit(kind)) for kind, words, patterns in kinds]
    return F.coalesce(*tagged, F.lit(values.OTHER_PIN))


def is_garbage_pin(name: Column) -> Column:
    """Dates, revisions, page marks and links that look like pin names."""
    up = F.upper(F.trim(name))
    month = F.substring(up, 1, 3).isin(*values.MONTHS) & _holds(up, (), values.DATE_PATTERNS, up)
    return (up == "") | month | _holds(up, (), values.GARBAGE_PATTERNS, up)


def is_meaningful_pin(name: Column) -> Column:
    """Names that tell what a pin is for."""
    low, up = F.lower(F.trim(name)), F.upper(F.trim(name))
    begins = reduce(Column.__or__, [F.startswith(up, F.lit(p)) for p in values.MEANINGFUL_PREFIXES])
    return begins | _holds(low, values.MEANINGFUL_WORDS, values.MEANINGFUL_PATTERNS, up)


def _find(k: int):
    return lambda x, i: F.struct(F.lit(k).alias("pattern"), i.alias("pos"), x["n"].try_cast("int").alias("pin"), F.upper(x["name"]).alias("name"))


def pins_of_hits(hits: DataFrame, lines: list[tuple[str, int, int]] = values.PIN_LINES) -> DataFrame:
    """``query_id, pin, name, type`` from ``hits(query_id, rank, text, package)``: the first find of each number.

    Hits are dealt by query before they are searched, as a small file of them would be searched by one task;
    finds stay where their query is.
    """
    hits = hits.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    finds = []
    for k, (pattern, number, name) in enumerate(lines):
        p = F.lit("(?i)" + pattern)
        finds.append(F.transform(F.arrays_zip(F.regexp_extract_all("text", p, F.lit(number)).alias("n"), F.regexp_extract_all("text", p, F.lit(name)).alias("name")), _find(k)))
    e = hits.select("query_id", "rank", most_pins(F.col("package")).alias("most"), F.inline(F.concat(*finds)))
    e = e.where("pin between 1 and most").where(~is_garbage_pin(F.col("name")))
    w = Window.partitionBy("query_id", "pin").orderBy("rank", "pattern", "pos")
    return e.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("query_id", "pin", "name", pin_type(F.col("name")).alias("type"))


def pin_decisions(pins: DataFrame, library: DataFrame) -> DataFrame:
    """Whether each chip's extracted pins are to be used, or the library's (``query_id, library_pins``)."""
    g = pins.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "io").alias("plain"), F.count_if(is_meaningful_pin(F.col("name"))).alias("meaningful"), F.countDistinct("name").alias("names"), F.max("pin").alias("last"))
    d = library.join(g, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    weak = (n < 4) | (F.col("plain") * 2 >= n) | (F.col("meaningful") == 0) | (F.col("names") < n) | (F.col("last") > n)
    share = n / F.nullif(F.col("library_pins"), F.lit(0))
    return d.select("query_id", n.alias("n"), F.when(weak | (share < 0.8) | (share > 1.2), "library").otherwise("extracted").alias("source"))


def valid_pins(pins: DataFrame) -> DataFrame:
    """Pin records with a number, a name and a known type; alternate functions other than the name; ``problem`` otherwise."""
    number = F.col("number").try_cast("int")
    kinds = ("power", "ground", "input", "output", "bidirectional", "analog", "special", "nc", "io")
    problem = F.when(number.isNull() | (number < 1), "number").when(F.trim(F.coalesce("name", F.lit(""))) == "", "name").when(~F.coalesce(F.col("type").isin(*kinds), F.lit(False)), "type")
    return pins.withColumns({"number": number, "problem": problem, "functions": F.filter("functions", lambda f: ~f.eqNullSafe(F.col("name")))})


def cited(citations: DataFrame, pins: DataFrame) -> DataFrame:
    """Citations that name a pin (two letters or more), all if none does; one of each file and page."""
    from sheetmill.operators.retrieval import or_all

    names = pins.where(F.length("name") >= 2).groupBy("query_id").agg(F.collect_set("name").alias("names"))
    d = citations.join(names, "query_id", "left")
    hit = F.exists("names", lambda n: F.contains(F.upper("snippet"), n))
    w = Window.partitionBy("query_id", "file", "page").orderBy("rank")
    return or_all(d, hit).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "names")


# -- queries --------------------------------------------------------------------------------------------
def _looked_up(words: Column, table: dict[str, list[str]], hit) -> Column:
    """What a table holds for the keys for which ``hit(key, words)``, in order."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(hit(F.lit(k), words), F.array(*(F.lit(x) for x in v))).otherwise(none) for k, v in table.items()))


def query_keywords(query: Column, stop: tuple[str, ...] = values.FIGURE_STOP_WORDS, synonyms: dict[str, list[str]] = values.FIGURE_SYNONYMS) -> Column:
    """Part numbers, terms between separators, runs of two CJK signs or more and Latin words, without stop words, then synonyms."""
    q = F.lower(F.trim(query))
    found = lambda p: F.regexp_extract_all(q, F.lit(p), F.lit(0))
    parts = F.filter(found(r"\b[a-z]*[0-9]{2,}[a-z0-9]*\b"), lambda w: F.length(w) >= 3)
    terms = F.filter(F.split(q, r"[\s,，、;；:：]+"), lambda w: w != "")
    pieces = F.flatten(F.transform(found("[\u4e00-\u9fff]{2,}"), lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.transform(F.sequence(F.lit(2), F.length(r) - i + 1), lambda n: F.substring(r, i, n))))))
    base = F.filter(F.array_distinct(F.concat(parts, terms, pieces, found("[a-z]{2,}"))), lambda w: ~w.isin(*stop))
    near = lambda key, ws: F.exists(ws, lambda w: F.contains(w, key) | F.contains(key, w))
    return F.array_distinct(F.concat(base, _looked_up(base, synonyms, near)))


def enriched_query(query: Column, most: int = 12, chips: tuple[str, ...] = values.ENRICHED_CHIPS, functions: dict[str, list[str]] = values.FUNCTION_WORDS) -> Column:
    """A query with phrases for its chips, or else with words for its functions, or else with the general word.

    What repeats without regard to case, or is a single sign, goes; ``most`` entries stay.
    """
    q, none = F.lower(query), F.array().cast("array<string>")
    says = lambda *ws: F.lit(False) if not ws else F.contains(q, F.lit(ws[0])) | says(*ws[1:])
    when = lambda c, x: F.when(c, F.array(x)).otherwise(none)
    named = F.filter(F.array(*(F.lit(c) for c in chips)), lambda c: F.contains(q, c))
    phrases = F.flatten(
        F.transform(
            named,
            lambda c: F.concat(
                when(~says("电路"), F.concat(c, F.lit("电路"))),
                when(~says("放大器") & says("放大"), F.concat(c, F.lit("放大器"))),
                when(~says("运放") & says("放大", "amplifier"), F.concat(c, F.lit("运放"))),
                F.array(c),
            ),
        )
    )
    told = F.concat(*(F.when(says(k, *(w.lower() for w in v)), F.array(*(F.lit(w) for w in v[:3]))).otherwise(none) for k, v in functions.items()))
    general = when((F.size(told) == 0) & ~says("电路"), F.concat(query, F.lit("电路")))
    entries = F.concat(F.array(query), F.when(F.size(named) > 0, phrases).otherwise(F.concat(told, general)))
    low = F.transform(entries, F.lower)
    first = F.filter(entries, lambda e, i: (F.length(e) > 1) & (F.array_position(low, F.lower(e)) == i + 1))
    return F.array_join(F.slice(first, 1, most), " ")


def rewritten_query(query: Column) -> Column:
    """Chip and up to three parameter words, or chip and a default phrase; the query itself without a chip."""
    chip = F.try_element_at(part_numbers(query), F.lit(1))
    words = F.array(*(F.lit(w) for w in values.REWRITE_WORDS))
    have = F.slice(F.filter(words, lambda w: F.contains(F.lower(query), w)), 1, 3)
    return F.when(chip.isNull(), query).when(F.size(have) > 0, F.concat_ws(" ", chip, F.array_join(have, " "))).otherwise(F.concat(chip, F.lit(" supply voltage operating voltage")))
