"""A quality score by a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of a text are columns. Trees are grown on a bounded sample of labelled rows; every path
from a root to a node is a rule, a conjunction of comparisons. A logistic model with a lasso penalty
weighs the rules and drops most of them. What is left is one column expression, so scoring a corpus
is a projection without Python.

The sample has at most about ``SAMPLE`` labelled rows, chosen by a hash of the id (a row's choice
depends on nothing but its id and the number of labelled rows).

Defined results: a null text is empty; an empty text has all statistics 0 and a score like any
other; without labels, or with labels of one kind, the score is the share of label 1 (0.5 without
any); repeated ids among the labels count once with their greatest label; null ids and null labels
teach nothing; repeated rows are scored each; further columns are ignored by ``scores`` and kept by
``accepted``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed

SAMPLE, TREES, DEPTH, LASSO, THRESHOLD = 16_000, 12, 3, 0.0005, 0.3


def statistics(t: Column) -> dict[str, Column]:
    """Statistics of a text that is not null."""
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.regexp_count(t, F.lit(r"\S+"))
    ones = lambda kind: F.length(t) - F.length(F.regexp_replace(t, kind, ""))  # noqa: E731 - signs of a kind
    n = F.greatest(words, F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return {
        "words": words.cast("double"),
        "word_length": F.length(F.regexp_replace(t, r"\s", "")) / n,
        "signs": ones(r"[^\p{L}\p{N}\s.,]") / size,
        "sign_runs": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]{2,}")) / n,
        "capitals": ones(r"\p{Lu}") / size,
        "shouted": F.regexp_count(t, F.lit(r"\p{Lu}{3,}")) / n,
        "digits": ones(r"\p{N}") / size,
        "bars": ones(r"\|") / n,
        "stops": ones(r"[.!?]") / n,
        "different_words": F.size(F.array_distinct(F.split(t, r"\s+"))) / n,
        "different_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


class Rule(NamedTuple):
    """A conjunction: (statistic, whether it is above the bound, bound)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for name, above, bound in self.parts:
            out = out & ((of(name) > bound) if above else (of(name) <= bound))
        return F.coalesce(out.cast("double"), F.lit(0.0))


class RuleModel(NamedTuple):
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        """The score, from columns with the names of the statistics."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.lit(w) * rule.column(of)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def simplified(parts: list[tuple[str, bool, float]]) -> Rule:
    """Of several bounds on one side of a statistic, the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, bound in parts:
        old = best.get((name, above))
        best[name, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return Rule(tuple(sorted((name, above, bound) for (name, above), bound in best.items())))


def paths(node, names: list[str], so_far: list[tuple[str, bool, float]]) -> list[Rule]:
    """The rule of each node below a node of a fitted tree."""
    if node.subtreeDepth() == 0:
        return []
    split, out = node.split(), []
    for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
        parts = [*so_far, (names[split.featureIndex()], above, float(split.threshold()))]
        out += [simplified(parts), *paths(child, names, parts)]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Learns from the rows of ``docs`` that ``labels(doc_id, <label>)`` names."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    n = marked.count()
    share = min(1.0, sample / max(n, 1))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # At most about ``sample`` rows of two numbers, whatever the number of labels: small enough to send to all.
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), t.alias("text")).join(F.broadcast(chosen), "doc_id")
    stats = statistics(F.col("text"))
    table = checkpointed(own.select("label", *(c.alias(k) for k, c in stats.items())))
    ones, rows = table.agg(F.sum("label"), F.count("*")).first()
    if not rows or not ones or ones == rows:
        p = min(max((ones or 0.0) / rows, 0.001), 0.999) if rows else 0.5
        import math

        return RuleModel((), (), math.log(p / (1 - p)))
    names = list(stats)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.6", subsamplingRate=0.7)
    grown = forest.fit(VectorAssembler(inputCols=names, outputCol="features").transform(table))
    rules = sorted({r for tree in grown._java_obj.trees() for r in paths(tree.rootNode(), names, [])})
    ruled = table.select("label", *(r.column().alias(f"r{k}") for k, r in enumerate(rules)))
    ruled = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(ruled).select("label", "features")
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(ruled)
    w = fitted.coefficients.toArray()
    keep = [k for k in range(len(rules)) if w[k] != 0.0]
    return RuleModel(tuple(rules[k] for k in keep), tuple(float(w[k]) for k in keep), float(fitted.intercept))


def score_of(t: Column, model: RuleModel) -> Column:
    """The score of a text that is not null.

    The statistics are the fields of one value to which the rules are applied as a function: wherever
    the optimiser moves the expression (a filter, say), each statistic is computed once for a text.
    """
    used = {part[0] for rule in model.rules for part in rule.parts}
    if not used:
        return model.score()
    one = F.struct(*(c.alias(k) for k, c in statistics(t).items() if k in used))
    return F.get(F.transform(F.array(one), lambda s: model.score(lambda name: s[name])), F.lit(0))


def scores(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row."""
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score_of(t, model).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, as they are; a null text is scored as an empty one, repeated rows all stay or go."""
    return docs.where(score_of(F.coalesce(docs["text"].cast("string"), F.lit("")), model) >= threshold)
