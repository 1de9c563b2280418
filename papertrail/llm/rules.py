"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on the statistics of labelled documents; every path from a root to a node is a conjunctive
rule. A logistic regression with a lasso penalty gives weights to few of the rules, and these become one Spark
column expression, so scoring is a projection without Python.

Labels are read for at most ``SAMPLE`` documents: those whose hashed id is smallest, the same ones in every run. All
statistics are taken from whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import stored

#: Most labelled documents that a model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0005, 11
#: Score from which a document counts as good.
ACCEPT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as empty. Shares of an empty text are 0."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    split = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "log_chars": F.log1p(F.length(text)),
        "symbols": share(r"[#$%&*|@^~<>={}\\_\[\]]"),
        "marks": share(r"[.,;:!?]"),
        "shouts": share(r"!{2,}|\?{2,}"),
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "blanks": share(r"\s"),
        "stutter": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+\1(?!\S)")) / F.size(split),
        "variety": F.size(F.array_distinct(split)) / F.size(split),
        "line_variety": F.size(F.array_distinct(lines)) / F.size(lines),
    }


NAMES = ["log_chars", "symbols", "marks", "shouts", "capitals", "digits", "blanks", "stutter", "variety", "line_variety"]


@dataclass(frozen=True)
class Rule:
    """Conjunction of conditions ``statistic <= bound`` (low) or ``statistic > bound``."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, bound in self.conditions:
            out = out & ((F.col(name) <= bound) if low else (F.col(name) > bound))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Share of label 1 that the rules predict, over columns with the statistics' names."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, names: list[str], above: tuple = ()) -> Iterator[Rule]:
    """Rules of all nodes below the root of a tree of the JVM."""
    if above:
        yield Rule(above)
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, bound = names[split.featureIndex()], float(split.threshold())
    yield from _paths(node.leftChild(), names, (*above, (name, True, bound)))
    yield from _paths(node.rightChild(), names, (*above, (name, False, bound)))


def _shortest(rule: Rule) -> Rule:
    """The rule with one condition for each statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, low, bound in rule.conditions:
        pick = min if low else max
        bounds[name, low] = pick(bound, bounds.get((name, low), bound))
    return Rule(tuple((name, low, bound) for (name, low), bound in sorted(bounds.items())))


def fit(labelled: DataFrame, label: str = "label") -> RuleEnsemble:
    """Rules and weights from rows with the statistics and a label 0 or 1.

    With one class only, or no row, the ensemble has no rule: its score is the class, or 1/2.
    """
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    if len(counts) < 2:
        return RuleEnsemble({frozenset({1}): 10.0, frozenset({0}): -10.0}.get(frozenset(counts), 0.0))
    rows = VectorAssembler(inputCols=NAMES, outputCol="statistics").transform(labelled)
    forest = RandomForestClassifier(featuresCol="statistics", labelCol=label, numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({_shortest(rule) for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), NAMES)},
                   key=lambda r: (len(r.conditions), r.conditions))
    if not rules:
        share = counts[1] / (counts[0] + counts[1])
        return RuleEnsemble(math.log(share / (1 - share)))
    names = [f"rule{i}" for i in range(len(rules))]
    held = labelled.select(label, *[rule.column().cast("double").alias(n) for n, rule in zip(names, rules)])
    rows = VectorAssembler(inputCols=names, outputCol="rules").transform(held)
    lasso = LogisticRegression(featuresCol="rules", labelCol=label, elasticNetParam=1.0, regParam=PENALTY, maxIter=60,
                               standardization=False).fit(rows)
    weights = tuple((rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray()) if w)
    return RuleEnsemble(float(lasso.intercept), weights)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> RuleEnsemble:
    """Fit on at most ``sample`` labelled documents that are not held out (see ``held_out``)."""
    train = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
    train = train.filter(~held_out(F.col("__id")) & F.col("label").isin(0, 1))
    chosen = train.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    # At most ``sample`` rows of two numbers, so the side is safe to broadcast.
    rows = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id")
    return fit(stored(rows.select("label", *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]), "labelled"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, ensemble: RuleEnsemble, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``accept`` on) in place of columns of these names.

    Null and empty texts are scored by their statistics, which are all 0; null ids and repeated rows are scored like
    others; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    columns = {f"__{n}": c.cast("double") for n, c in statistics(F.col("text")).items()}
    clash = {n: f"__own_{n}" for n in own if n in NAMES}
    measured = docs.select(*[F.col(c).alias(clash.get(c, c)) for c in own], *[c.alias(n[2:]) for n, c in columns.items()])
    # The id is times 0; it keeps the optimizer from writing the statistics out once per rule in a filter on the score.
    score = ensemble.score() + 0.0 * F.monotonically_increasing_id()
    scored = measured.withColumn("score", score).withColumn("predicted", (F.col("score") >= accept).cast("int"))
    return scored.select(*[F.col(clash.get(c, c)).alias(c) for c in own], "score", "predicted")


def accepted(docs: DataFrame, ensemble: RuleEnsemble, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as they came."""
    kept = {c: f"__kept_{c}" for c in docs.columns if c in ("score", "predicted")}
    marked = classify(docs.withColumns({v: F.col(k) for k, v in kept.items()}), ensemble, accept)
    return marked.filter("predicted = 1").select([F.col(kept.get(c, c)).alias(c) for c in docs.columns])
