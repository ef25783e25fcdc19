"""Activation routing: which modules run for an event and what they suggest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph import model

CONTROLLER = "meta.controller"
# Extra activation per event type.
INJECTION: dict[str, dict[str, float]] = {
    "*": {"module.belief_prior_adjuster": 0.05},
    "pipeline.stage_completed": {"module.learning_signal_router": 0.4},
    "ontology.candidate_detected": {"module.ontology_proposal_summariser": 0.5},
    "feedback.received": {"module.learning_signal_router": 0.35},
}
ANY = "*"


def activation_table(spark: SparkSession, injection: Mapping[str, Mapping[str, float]] = INJECTION, base: Mapping[str, float] = model.ACTIVATION["base"],
                     edges: Sequence[tuple[str, str, float]] = model.ACTIVATION["edges"], damping: float = model.ACTIVATION["damping"],
                     steps: int = model.ACTIVATION["steps"]) -> DataFrame:
    """(event_type, module, activation).  Activation depends on the type only, so it is worked out once per type.

    Types without an entry of their own are under ``*``.  Everything here is rule-sized.
    """
    types = sorted(set(injection) | {ANY})
    modules = sorted(set(base) | {m for v in injection.values() for m in v} | {x for s, t, _ in edges for x in (s, t)})
    start = [(t, m, base.get(m, 0.0) + injection.get(ANY, {}).get(m, 0.0) + (injection[t].get(m, 0.0) if t != ANY and t in injection else 0.0))
             for t in types for m in modules]
    current = model.rule_table(spark, start, "event_type string, module string, activation double")
    links = model.rule_table(spark, edges, "source string, target string, weight double")
    for _ in range(steps):
        flow = current.join(links, current["module"] == links["source"]).select(
            "event_type", F.col("target").alias("module"), (F.col("activation") * F.col("weight")).alias("activation"))
        current = current.unionByName(flow).groupBy("event_type", "module").agg(F.sum("activation").alias("activation")) \
            .withColumn("activation", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("activation") * damping)))
    return current


def routed(events: DataFrame, activation: DataFrame, threshold: float = model.ACTIVATION["threshold"]) -> DataFrame:
    """Events joined with the modules they activate; the controller's own events are ignored.  Works on streams."""
    known = [t for t in INJECTION if t != ANY]
    keyed = events.filter(F.coalesce("producer", F.lit("")) != CONTROLLER).withColumn(
        "route", F.when(F.col("event_type").isin(*known), F.col("event_type")).otherwise(ANY))
    live = activation.filter(F.col("activation") >= threshold).withColumnRenamed("event_type", "route")
    return keyed.join(F.broadcast(live), "route").drop("route")  # one row per type and module


def suggestions(routes: DataFrame) -> DataFrame:
    """What each activated module suggests, with the ids that tie it to its event."""
    a, module = F.col("activation"), F.col("module")
    kind = F.when(module == "module.belief_prior_adjuster", "belief_prior_adjustment").when(
        module == "module.ontology_proposal_summariser", "ontology_proposal_summary").otherwise("learning_signal_route")
    concepts = F.json_array_length(F.get_json_object("payload", "$.candidate_concepts"))
    signals = F.array_compact(F.array(*[F.when(F.get_json_object("payload", f"$.{k}").isNotNull(), k) for k in ("feedback", "scores", "signals")]))
    return routes.select(
        F.concat(F.lit("suggestion."), kind).alias("event_type"), F.lit(CONTROLLER).alias("producer"),
        F.coalesce("correlation_id", "event_id").alias("correlation_id"), F.col("event_id").alias("causation_id"), "module",
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), a)).alias("confidence"),
        F.when(kind == "belief_prior_adjustment", F.round((a - 0.5) * 0.4, 3)).alias("recommended_adjustment"),
        F.when(kind == "ontology_proposal_summary", F.coalesce(concepts, F.lit(0))).alias("candidate_count"),
        F.when(kind == "learning_signal_route", F.array_join(signals, ",")).alias("signals"),
        F.when(kind == "learning_signal_route", F.when(a < 0.75, "mid_term").otherwise("long_term_candidate")).alias("persistence_tier"))


def allowed(events: DataFrame, mode: str, pipelines: Sequence[str] = model.ACTIVATION["allowed_pipelines"],
            modules: Sequence[str] = model.ACTIVATION["allowed_modules"]) -> DataFrame:
    """Gate of published events: shadow lets suggestions through, active also what the allow-lists name."""
    suggestion = F.col("event_type").startswith("suggestion.")
    if mode == "shadow":
        return events.filter(suggestion)
    def listed(path: str, names: Sequence[str]) -> Column:
        return F.coalesce(F.get_json_object("payload", path).isin(*names), F.lit(False))

    return events.filter(suggestion | listed("$.pipeline_id", pipelines) | listed("$.module_name", modules))
