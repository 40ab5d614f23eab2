"""URL filtering: rules by host and path, and gradient-boosted trees for the URLs that no rule names.

Lexical features of a URL are columns: its length and depth, the share of digits, the entropy of its
characters, its parameters, hyphens and host labels, and how often labelled URLs with the same last
one and last two labels of the host are blocked (smoothed). The trees are trained on labelled URLs, at
most about ``SAMPLE`` of them, chosen by a hash of the URL. In training, a URL's rates are those of the
other ``FOLDS - 1`` folds (by a hash of the URL), so that they never hold its own label. ``judged`` takes
the URLs that a rule names as the labelled ones.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule, and is
judged by its other features; without labelled URLs of both kinds the verdict is the kind that
there is, and ``allow`` if there is none; repeated rows are judged each; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed

SAMPLE, TREES, DEPTH, PRIOR, FOLDS = 20_000, 10, 3, 5.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): the rule's host, then the beginning of the path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "path_length", "last_rate", "domain_rate")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule is put before the shorter ones
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.split(url, "")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / size
    entropy = -F.aggregate(F.transform(F.array_distinct(chars), lambda ch: share(ch) * F.ln(share(ch)) / math.log(2)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return {
        "length": F.length(url).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "entropy": entropy,
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
        "hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
        "labels": F.when(host == "", 0).otherwise(F.regexp_count(host, F.lit(r"\.")) + 1).cast("double"),
        "path_length": F.length(path).cast("double"),
    }


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """All columns of ``urls``, with host, path, the host's last one and two labels, and lexical features."""
    u = F.coalesce(F.col(url), F.lit(""))
    out = urls.withColumns({"host": host_of(u), "path": path_of(u)})
    out = out.withColumns({"last": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    return out.withColumns(lexical(u, F.col("host"), F.col("path")))


class UrlModel:
    """Fitted trees and the block rates of suffixes; ``constant`` if there was nothing to learn from."""

    def __init__(self, trees, last: DataFrame | None, domain: DataFrame | None, base: float, constant: str | None) -> None:
        self.trees, self.last, self.domain, self.base, self.constant = trees, last, domain, base, constant

    def rated(self, rows: DataFrame) -> DataFrame:
        out = rows.join(self.last, "last", "left").join(self.domain, "domain", "left")
        return out.withColumns({"last_rate": F.coalesce("last_rate", F.lit(self.base)), "domain_rate": F.coalesce("domain_rate", F.lit(self.base))})

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with features) and the method's verdict as ``own``."""
        if self.constant:
            return rows.withColumn("own", F.lit(self.constant))
        out = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(self.rated(rows)))
        return out.withColumn("own", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Learns from rows with features and ``label`` (1: block)."""
    total, ones = labelled.agg(F.count("*"), F.sum("label")).first()
    if not total or not ones or ones == total:
        return UrlModel(None, None, None, 0.0, "block" if total and ones else "allow")
    share = min(1.0, sample / total)
    table = checkpointed(labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < share * 1_000_003))
    base = float(ones) / total

    def rate(ones: Column, n: Column) -> Column:
        return (ones + PRIOR * base) / (n + PRIOR)

    # Rates are those of all labelled URLs, not of the sample.
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    totals, train = {}, table.withColumn("fold", fold)
    for by in ("last", "domain"):
        parts = checkpointed(labelled.groupBy(by, fold.alias("fold")).agg(F.sum("label").alias("ones"), F.count("*").alias("n")))
        whole = parts.groupBy(by).agg(F.sum("ones").alias("all_ones"), F.sum("n").alias("all_n"))
        totals[by] = checkpointed(whole.select(by, rate(F.col("all_ones"), F.col("all_n")).alias(f"{by}_rate")))
        others = parts.join(whole, by).select(by, "fold", rate(F.col("all_ones") - F.col("ones"), F.col("all_n") - F.col("n")).alias(f"{by}_rate"))
        train = train.join(others, [by, "fold"])
    model = UrlModel(None, totals["last"], totals["domain"], base, None)
    ready = checkpointed(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("features", "label"))
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11).fit(ready)
    return model


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row: the longest rule's verdict, else the trees'."""
    rows = with_features(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    model = fit(rows.where("by_rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("double")), sample)
    return model.verdicts(rows).select("page_id", "host", "path", "rule", F.coalesce("by_rule", "own").alias("verdict"))
