"""The path scoring policy: features, evaluation, training and outcome logging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions import ids
from kithgraph.functions.text import strip
from kithgraph.functions.values import recency, rounded
from kithgraph.functions.vectors import sigmoid


ROWS_PER_TASK = 20_000  # samples a training task takes before more tasks pay off


@dataclass(frozen=True)
class Policy:
    """Per outcome an intercept and sparse weights.  A model artefact of a few dozen numbers."""

    version: str = "1.0.0"
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    intercepts: Mapping[str, float] = field(default_factory=dict)
    trained_before: bool = False

    def of(self, outcome: str = "materialised") -> tuple[float, Mapping[str, float]]:
        return float(self.intercepts.get(outcome, 0.0)), self.weights.get(outcome, {})

    @property
    def trained(self) -> bool:
        intercept, weights = self.of()
        return self.trained_before or abs(intercept) > 1e-9 or any(abs(w) > 1e-9 for w in weights.values())


def contributions(features: Column, policy: Policy) -> Column:
    _, weights = policy.of()
    if not weights:
        return F.transform_values(features, lambda k, v: v * 0.0)
    table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))])
    return F.transform_values(features, lambda k, v: v * F.coalesce(F.element_at(table, k), F.lit(0.0)))


def score(contribs: Column, policy: Policy) -> Column:
    total = F.aggregate(F.array_sort(F.map_entries(contribs)), F.lit(policy.of()[0]), lambda acc, e: acc + e["value"])
    return sigmoid(total)


def top_features(contribs: Column, n: int = 3) -> Column:
    """Largest contributions by absolute value; names settle ties."""
    keyed = F.transform(F.map_entries(contribs), lambda e: F.struct(
        (-F.abs(e["value"])).alias("rank"), e["key"].alias("feature"), e["value"].alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n),
                       lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution")))


def explanation(score_col: Column, top: Column, policy: Policy) -> Column:
    text = F.array_join(F.transform(top, lambda e: F.format_string("%s=%+.3f", e["feature"], rounded(e["contribution"], 3))), ", ")
    return F.format_string("Path score %.2f from logistic policy v%s; top contributions: %s.", rounded(score_col, 2),
                           F.lit(policy.version), F.when(text == "", "none").otherwise(text))


def evaluate(df: DataFrame, policy: Policy, features: str = "features") -> DataFrame:
    """Add score, contributions, top features and the explanation.  Row-local: no shuffle."""
    out = df.withColumn("contributions", contributions(F.col(features), policy))
    out = out.withColumn("score", score(F.col("contributions"), policy))
    out = out.withColumn("top", top_features(F.col("contributions")))
    return out.withColumn("explanation", explanation(F.col("score"), F.col("top"), policy))


def entity_score(df: DataFrame, policy: Policy, features: str = "features") -> DataFrame:
    """Score of an entity; an untrained policy gives the neutral 0.5 without contributions."""
    if policy.trained:
        return evaluate(df, policy, features)
    none = F.create_map().cast("map<string,double>")
    return (df.withColumn("contributions", none).withColumn("score", F.lit(0.5))
            .withColumn("top", top_features(none))
            .withColumn("explanation", F.lit("Neutral fallback because reasoning path model is not trained.")))


def edge_mix(rels: Column) -> Column:
    """Share of each relationship type in a path, as feature entries."""
    names = F.filter(F.transform(rels, lambda r: F.lower(strip(r))), lambda r: r != "")
    total = F.size(names)
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda r: F.struct(
        F.concat(F.lit("edge_type::"), r).alias("key"),
        (F.size(F.filter(names, lambda x: x == r)) / total).cast("double").alias("value"))))


def edge_shares(edges: DataFrame, path: str, rel: str) -> DataFrame:
    """The same shares for paths kept as rows; counted before they meet, so long paths stay cheap."""
    counts = edges.groupBy(path, rel).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(path)))


def path_features(nodes: Column, edges: Column, as_of: Column) -> Column:
    """Feature map of a path given as arrays of node and edge structs.

    Nodes: ``sentiment_score``, ``influence``, ``due_at``; edges: ``rel``, ``seen_at``.
    """
    seen = F.filter(F.transform(edges, lambda e: e["seen_at"]), lambda s: s.isNotNull())
    seen_mean = F.aggregate(seen, F.lit(0.0), lambda acc, s: acc + recency(as_of, s)) / F.size(seen)
    moods = F.filter(F.transform(nodes, lambda n: n["sentiment_score"]), lambda s: s.isNotNull())
    slope = (F.get(moods, F.size(moods) - 1) - F.get(moods, 0)) / (F.size(moods) - 1)
    dues = F.filter(F.transform(nodes, lambda n: n["due_at"]), lambda s: s.isNotNull())
    ages = F.transform(dues, lambda d: F.greatest(
        F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(d)) / F.lit(86_400_000_000.0)))
    base = F.create_map(
        F.lit("path_length"), F.size(edges).cast("double"),
        F.lit("recency"), F.when(F.size(seen) > 0, seen_mean).otherwise(0.5),
        F.lit("sentiment_slope"), F.when(F.size(moods) >= 2, slope).otherwise(0.0),
        F.lit("commitment_age"), F.coalesce(F.array_max(ages), F.lit(0.0)),
        F.lit("influence_centrality"), F.coalesce(F.array_max(F.transform(nodes, lambda n: n["influence"])), F.lit(0.0)))
    return F.map_concat(base, edge_mix(F.transform(edges, lambda e: e["rel"])))


def predicted_outcome(score_col: Column) -> Column:
    return F.when(score_col >= 0.55, "materialised").when(score_col >= 0.35, "acknowledged").otherwise("false_positive")


def accuracy(labelled: DataFrame, policy: Policy) -> DataFrame:
    scored = evaluate(labelled, policy)
    hit = (predicted_outcome(F.col("score")) == F.col("outcome")).cast("double")
    return scored.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def _blocks(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a partition as arrays, a few thousand at a time."""
    while batch := list(islice(rows, 4096)):
        yield (np.array([r["x"] for r in batch], dtype=float),
               np.array([[r["outcome"] == o for o in model.OUTCOMES] for r in batch], dtype=float),
               np.array([r["n"] for r in batch], dtype=float))


def _gradient(block: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    x, y, n = block
    z = x @ w.T
    small = np.exp(-np.abs(z))
    p = np.where(z >= 0, 1.0, small) / (1.0 + small)
    return ((p - y) * n[:, None]).T @ x


def train(labelled: DataFrame, version: str = "1.0.0", epochs: int = model.TRAINING["epochs"],
          learning_rate: float = model.TRAINING["learning_rate"], l2: float = model.TRAINING["l2"]) -> Policy:
    """Full-batch gradient descent, one-vs-rest, from zero.

    Equal samples are merged with a count first.  Each step is one reduction: every block of rows, cached on
    its executor, gives one partial gradient for all outcomes and only those few numbers travel.
    """
    rows = labelled.filter(F.col("outcome").isin(*model.OUTCOMES)).select("outcome", "features")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("features")).alias("k")).distinct().orderBy("k").collect()]
    vector = F.array(*[F.coalesce(F.element_at("features", n), F.lit(0.0)) for n in names], F.lit(1.0))
    packed = rows.select("outcome", vector.alias("x")).groupBy("outcome", "x").agg(F.count("*").alias("n")).cache()
    total, distinct = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        packed.unpersist()
        zero = {o: {k: 0.0 for k in model.FEATURE_KEYS} for o in model.OUTCOMES}
        return Policy(version, zero, {o: 0.0 for o in model.OUTCOMES})
    width, k = len(names) + 1, len(model.OUTCOMES)
    tasks = min(packed.rdd.getNumPartitions(), math.ceil(distinct / ROWS_PER_TASK))
    blocks = packed.rdd.coalesce(tasks).mapPartitions(_blocks)
    decay = np.array([l2] * len(names) + [0.0])

    def descend(gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        w = np.zeros((k, width))
        for _ in range(epochs):
            w = w - learning_rate * (gradient(w) / total + decay * w)
        return w

    if tasks == 1:  # at most ROWS_PER_TASK samples: all steps run beside them, in one task
        def alone(mine: Iterator) -> Iterator[np.ndarray]:
            held = list(mine)
            yield descend(lambda w: sum(_gradient(b, w) for b in held))

        w = blocks.mapPartitions(alone).first()
    else:
        blocks = blocks.cache()
        w = descend(lambda w: blocks.map(lambda b: _gradient(b, w)).treeReduce(np.add))
        blocks.unpersist()
    packed.unpersist()
    return Policy(version, {o: dict(zip(names, map(float, w[i, :-1]))) for i, o in enumerate(model.OUTCOMES)},
                  {o: float(w[i, -1]) for i, o in enumerate(model.OUTCOMES)}, True)


def train_with_mllib(labelled: DataFrame, version: str = "1.0.0") -> Policy:
    """Converged fit of the same objective by Spark's own logistic regression, for large sample logs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.filter(F.col("outcome").isin(*model.OUTCOMES)).select("outcome", "features")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("features")).alias("k")).distinct().orderBy("k").collect()]
    data = rows.select("outcome", array_to_vector(
        F.array(*[F.coalesce(F.element_at("features", n), F.lit(0.0)) for n in names])).alias("features")).cache()
    weights, intercepts = {}, {}
    for outcome in model.OUTCOMES:
        fit = LogisticRegression(regParam=model.TRAINING["l2"], standardization=False, maxIter=100).fit(
            data.withColumn("label", (F.col("outcome") == outcome).cast("double")))
        weights[outcome] = dict(zip(names, map(float, fit.coefficients)))
        intercepts[outcome] = float(fit.intercept)
    data.unpersist()
    return Policy(version, weights, intercepts, True)


def outcome_label(status: Column) -> Column:
    low = F.lower(strip(status))
    out = F.lit(None).cast("string")
    for name, label in model.OUTCOME_OF_STATUS.items():
        out = F.when(low == name, label).otherwise(out)
    return out


def new_samples(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to append to the reinforcement log: valid outcome, key not logged yet, one per key."""
    keyed = rows.filter(F.lower(strip(F.col("outcome"))).isin(*model.OUTCOMES)).withColumn(
        "sample_key", ids.sample_key(F.col("alert_id"), F.col("outcome"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
                                     F.map_keys("features")))
    fresh = keyed.join(log.select("sample_key"), "sample_key", "left_anti")
    picked = fresh.groupBy("sample_key").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "sample_key"]),
                                                      F.struct("timestamp", F.col("alert_id"))).alias("row"))
    return picked.select("sample_key", "row.*")


def archive(versions: DataFrame, keep: int = model.ARCHIVE_LIMIT) -> DataFrame:
    """Newest entries of each policy's archive."""
    w = Window.partitionBy("policy_id").orderBy(F.desc("archived_at"), F.desc("version"))
    return versions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= keep)
