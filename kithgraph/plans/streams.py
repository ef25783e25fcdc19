"""Streaming queries: each runs a stream over the events or turns to its end and reads the sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import first_words, plural_label
from kithgraph.plans.registry import query
from kithgraph.session import scratch_path
from kithgraph.sources.graph import Graph
from kithgraph.streaming import bus, memory, routing

TYPE_OF_EVENT = {"error": "feedback.received", "view": "pipeline.stage_completed", "click": "ontology.candidate_detected", "purchase": "graph.update", "signup": "graph.update"}
TYPE_SQL = "CASE event_type WHEN 'error' THEN 'feedback.received' WHEN 'view' THEN 'pipeline.stage_completed' WHEN 'click' THEN 'ontology.candidate_detected' ELSE 'graph.update' END"


def event_stream(g: Graph) -> DataFrame:
    rows = bus.file_stream(g.spark, os.path.join(g.folder, "events.parquet"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def envelopes(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for k, v in TYPE_OF_EVENT.items():
        mapped = F.when(kind == k, v).otherwise(mapped)
    payload = F.when(kind == "click", F.concat(F.lit('{"candidate_concepts":["a","b"],"x":'), "props", F.lit("}"))) \
        .when(kind == "error", F.lit('{"feedback":1,"scores":[2]}')).when(kind == "purchase", '{"pipeline_id":"pipeline.concept_update"}').otherwise(F.col("props"))
    return rows.select(F.col("event_id").cast("string").alias("event_id"), mapped.alias("event_type"), F.when(kind == "signup", routing.CONTROLLER).otherwise("ui").alias("producer"),
                       F.when(kind == "view", F.concat(F.lit("c"), "user_id")).alias("correlation_id"), payload.alias("payload"), F.col("ts").alias("occurred_at"))


@query("t01_broadcast_bus", sql="""
SELECT 'all' AS subscriber, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'""", graph=False)
def broadcast_bus(g: Graph) -> DataFrame:
    """Two subscribers of one source, each with its own checkpoint and sink."""
    everything = bus.drain(event_stream(g), "all")
    errors = bus.drain(event_stream(g).filter("event_type = 'error'"), "errors")
    read = g.spark.read.parquet
    return read(everything).agg(F.lit("all").alias("subscriber"), F.count("*").alias("n")).unionByName(
        read(errors).agg(F.lit("errors").alias("subscriber"), F.count("*").alias("n")))


@query("t02_replayable_stream", sql="SELECT event_type, count(*)::BIGINT AS n, count(*)::BIGINT AS n_replayed FROM events GROUP BY 1", graph=False)
def replayable_stream(g: Graph) -> DataFrame:
    """Consume, start again from the checkpoint, and let a second group replay from the first event; a redelivered event adds no row."""
    first, second, group = (scratch_path(g.spark, n) for n in ("consumed", "replayed", "group"))
    for path, checkpoint in ((first, group), (first, group), (second, group + "-replay")):
        events = bus.distinct_events(event_stream(g).unionByName(event_stream(g)), at="ts")  # everything is delivered twice
        bus.subscribe(events, bus.idempotent_append(path), checkpoint).awaitTermination()
    consumed = g.spark.read.parquet(first).groupBy("event_type").agg(F.count("*").alias("n"))
    return consumed.join(g.spark.read.parquet(second).groupBy("event_type").agg(F.count("*").alias("n_replayed")), "event_type")


@query("t03_envelope_validation", sql="""
SELECT event_type NOT IN ('click', 'signup') AND NOT (event_type = 'view' AND value > 10) AS valid, count(*)::BIGINT AS n, count(*) FILTER (event_type NOT IN ('click', 'signup') AND NOT (event_type = 'view' AND value > 10) AND hour(ts) < 12)::BIGINT AS n_morning FROM events GROUP BY 1""", graph=False)
def envelope_validation(g: Graph) -> DataFrame:
    """Clicks are cut off, sign-ups have no id, some views are over-confident; the rest is valid."""
    kind = F.col("event_type")
    body = F.to_json(F.struct(F.when(kind != "signup", F.col("event_id").cast("string")).alias("event_id"), kind.alias("event_type"),
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.when(kind == "view", F.col("value") / 10.0).alias("confidence")))
    raw = event_stream(g).select(F.when(kind == "click", F.left(body, F.lit(20))).otherwise(body).alias("value"))
    rows = g.spark.read.parquet(bus.drain(bus.validated(raw), "validated"))
    return rows.groupBy("valid").agg(F.count("*").alias("n"), F.count_if(F.col("valid") & (F.hour("occurred_at") < 12)).alias("n_morning"))


ACTIVATION_SQL = f"""
WITH mods AS (SELECT unnest(['module.belief_prior_adjuster','module.ontology_proposal_summariser','module.learning_signal_router']) AS m),
inj(t, m, v) AS (VALUES ('pipeline.stage_completed','module.learning_signal_router',0.4::DOUBLE), ('ontology.candidate_detected','module.ontology_proposal_summariser',0.5), ('feedback.received','module.learning_signal_router',0.35)),
links(s, d, w) AS (VALUES ('module.belief_prior_adjuster','module.learning_signal_router',0.2::DOUBLE), ('module.ontology_proposal_summariser','module.learning_signal_router',0.25), ('module.learning_signal_router','module.belief_prior_adjuster',0.15)),
types AS (SELECT DISTINCT {TYPE_SQL} AS t FROM events),
a0 AS (SELECT t.t, mods.m, 0.2 + CASE WHEN mods.m = 'module.belief_prior_adjuster' THEN 0.05 ELSE 0 END + coalesce(inj.v, 0) AS a FROM types t CROSS JOIN mods LEFT JOIN inj ON inj.t = t.t AND inj.m = mods.m),
a1 AS (SELECT t, m, least(1.0, greatest(0.0, 0.85 * (a + coalesce((SELECT sum(b.a * w) FROM a0 b JOIN links ON s = b.m WHERE b.t = a0.t AND d = a0.m), 0)))) AS a FROM a0),
a2 AS (SELECT t, m, least(1.0, greatest(0.0, 0.85 * (a + coalesce((SELECT sum(b.a * w) FROM a1 b JOIN links ON s = b.m WHERE b.t = a1.t AND d = a1.m), 0)))) AS a FROM a1),
runs AS (SELECT e.*, {TYPE_SQL} AS t, a2.m, a2.a FROM events e JOIN a2 ON a2.t = {TYPE_SQL} WHERE a2.a >= 0.45 AND e.event_type <> 'signup')
"""


@query("t04_activation_routing", sql=ACTIVATION_SQL + "SELECT t AS event_type, m AS module, round(a, 6) AS activation, count(*)::BIGINT AS n FROM runs GROUP BY ALL", graph=False)
def activation_routing(g: Graph) -> DataFrame:
    routes = routing.routed(envelopes(event_stream(g)), routing.activation_table(g.spark))
    rows = g.spark.read.parquet(bus.drain(routes, "routed"))
    return rows.groupBy("event_type", "module", F.round("activation", 6).alias("activation")).agg(F.count("*").alias("n"))


@query("t05_suggestions", sql=ACTIVATION_SQL + """
SELECT CASE m WHEN 'module.belief_prior_adjuster' THEN 'suggestion.belief_prior_adjustment' WHEN 'module.ontology_proposal_summariser' THEN 'suggestion.ontology_proposal_summary' ELSE 'suggestion.learning_signal_route' END AS event_type,
  event_id::VARCHAR AS causation_id, CASE WHEN event_type = 'view' THEN 'c'||user_id ELSE event_id::VARCHAR END AS correlation_id, round(greatest(0.1, least(1.0, a)), 6) AS confidence,
  CASE WHEN m = 'module.ontology_proposal_summariser' THEN CASE WHEN event_type = 'click' THEN 2 ELSE 0 END END::BIGINT AS candidate_count,
  CASE WHEN m = 'module.learning_signal_router' THEN CASE WHEN event_type = 'error' THEN 'feedback,scores' ELSE '' END END AS signals, CASE WHEN m = 'module.learning_signal_router' THEN CASE WHEN a < 0.75 THEN 'mid_term' ELSE 'long_term_candidate' END END AS persistence_tier FROM runs""", graph=False)
def suggestions(g: Graph) -> DataFrame:
    stream = routing.suggestions(routing.routed(envelopes(event_stream(g)), routing.activation_table(g.spark)))
    rows = g.spark.read.parquet(bus.drain(stream, "suggestions"))
    return rows.select("event_type", "causation_id", "correlation_id", F.round("confidence", 6).alias("confidence"), F.col("candidate_count").cast("bigint").alias("candidate_count"),
                       "signals", "persistence_tier")


@query("t06_gate", sql=ACTIVATION_SQL + """
SELECT 'shadow' AS mode, (SELECT count(*) FROM runs)::BIGINT AS n UNION ALL SELECT 'active', (SELECT count(*) FROM runs) + (SELECT count(*) FROM events WHERE event_type = 'purchase')""", graph=False)
def gate(g: Graph) -> DataFrame:
    """Suggestions and plain events through both gates."""
    plain = envelopes(event_stream(g)).select("event_type", "payload")
    made = routing.suggestions(routing.routed(envelopes(event_stream(g)), routing.activation_table(g.spark))).select("event_type", F.lit("{}").alias("payload"))
    out = None
    for mode in ("shadow", "active"):
        rows = g.spark.read.parquet(bus.drain(routing.allowed(plain.unionByName(made), mode), mode)).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- memory -----------------------------------------------------------------------------

# Every event uses its user's item of its kind; errors reinforce, some purchases pin.
MEMORY_SQL = """
WITH uses AS (SELECT 'session:'||user_id AS session_id, event_type AS item_id, CASE WHEN event_type = 'error' THEN 'reinforce' WHEN event_type = 'purchase' AND value > 15 THEN 'pin' ELSE 'record' END AS op, least(1.0, value / 20.0) AS importance, props AS content, ts FROM events),
gaps AS (SELECT *, CASE WHEN coalesce(bool_or(op = 'pin') OVER (PARTITION BY session_id, item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 0
   WHEN ts - lag(ts) OVER (PARTITION BY session_id, item_id ORDER BY ts) > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS fresh FROM uses),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, item_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM gaps),
lives AS (SELECT session_id, item_id, life, min(ts) AS created_at, max(ts) AS last_used, max(importance) AS importance, count(*) FILTER (op = 'reinforce')::DOUBLE AS strength, bool_or(op = 'pin') AS pinned, arg_max(content, ts) AS content FROM numbered GROUP BY ALL)
"""


def uses(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "error", "reinforce").when((kind == "purchase") & (F.col("value") > 15), "pin").otherwise("record")
    return rows.select(F.concat(F.lit("session:"), "user_id").alias("session_id"), kind.alias("item_id"), op.alias("op"),
                       F.least(F.lit(1.0), F.col("value") / 20.0).alias("importance"), F.col("props").alias("content"), "ts")


def lives(g: Graph) -> DataFrame:
    return memory.item_lives(uses(g.table("events")))


@query("t07_short_term_memory", sql=MEMORY_SQL + """
SELECT session_id, item_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used, round(importance, 6) AS importance
FROM lives WHERE NOT pinned AND last_used + INTERVAL 3600 SECOND < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", graph=False)
def short_term_memory(g: Graph) -> DataFrame:
    """The stream of items whose time ran out: the watermark closes them."""
    stream = memory.item_lives(uses(event_stream(g)).withWatermark("ts", "10 minutes"))
    rows = g.spark.read.parquet(bus.drain(stream, "expired"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return rows.select("session_id", "item_id", F.date_format("created_at", stamp).alias("created_at"), F.date_format("last_used", stamp).alias("last_used"),
                       F.round("importance", 6).alias("importance"))


@query("t08_reinforcement", sql=MEMORY_SQL + """
SELECT session_id, item_id, sum(strength)::DOUBLE AS strength, strftime(max(last_used), '%Y-%m-%d %H:%M:%S') AS last_used, bool_or(pinned) AS pinned FROM lives GROUP BY ALL""", graph=False)
def reinforcement(g: Graph) -> DataFrame:
    return lives(g).groupBy("session_id", "item_id").agg(F.sum("strength").cast("double").alias("strength"), F.date_format(F.max("last_used"), "yyyy-MM-dd HH:mm:ss").alias("last_used"),
                                                         F.bool_or("pinned").alias("pinned"))


@query("t09_promotion", sql=MEMORY_SQL + """,
live AS (SELECT * FROM lives WHERE created_at <= TIMESTAMP '2024-01-30' AND (pinned OR last_used + INTERVAL 3600 SECOND >= TIMESTAMP '2024-01-30')),
mid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, item_id) AS rn FROM live) WHERE rn <= 50 AND importance >= 0.7)
SELECT session_id, item_id, pinned OR importance >= 0.85 OR strength >= 3 AS long_term FROM mid""", graph=False)
def promotion(g: Graph) -> DataFrame:
    """Items in memory at a moment that are promoted, and whether they go on to long-term memory."""
    live = memory.live_at(lives(g), F.lit("2024-01-30").cast("timestamp"))
    mid = memory.promoted_to_mid(live)
    ready, rest = memory.promoted_to_long(mid)
    return ready.select("session_id", "item_id", F.lit(True).alias("long_term")).unionByName(
        rest.filter(~F.col("pinned")).select("session_id", "item_id", F.lit(False).alias("long_term")))


@query("w04_session_cap", sql=MEMORY_SQL + """
SELECT session_id, count(*)::BIGINT AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, item_id DESC) AS rn FROM lives) WHERE rn <= 100 GROUP BY 1""", graph=False)
def session_cap(g: Graph) -> DataFrame:
    return memory.capped(lives(g)).groupBy("session_id").agg(F.count("*").alias("n"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest"))


SUMMARY_SQL = r""",
said AS (SELECT session_id, turn, list_aggregate(list_filter(regexp_split_to_array(trim(text, ' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)), '\s+'), lambda t: t <> '')[1:5], 'string_agg', ' ') AS summary FROM turns),
last5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM said) WHERE rn <= 5)
SELECT session_id, coalesce(string_agg(CASE WHEN summary <> '' THEN summary END, '; ' ORDER BY turn), '') AS summary, count(*)::BIGINT AS n FROM last5 GROUP BY 1"""


def said(turns: DataFrame) -> DataFrame:
    return turns.select("session_id", "turn", first_words(F.col("text"), 5).alias("summary"))


@query("w03_session_history", sql=SUMMARY_SQL)
def session_history(g: Graph) -> DataFrame:
    history = memory.recent_history(said(g.turns), "session_id", [F.desc("turn")])
    return memory.session_summary(history).select("session_id", "summary", F.col("n").cast("bigint").alias("n"))


@query("t10_session_summary", sql=SUMMARY_SQL)
def streamed_summary(g: Graph) -> DataFrame:
    """The same summary kept up to date by a stream: each micro-batch writes a new version of the history."""
    root, done = scratch_path(g.spark, "history"), []

    def update(batch: DataFrame, number: int) -> None:
        """Version n is made of version n - 1 and batch n, so a batch that runs again gives the same version."""
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{root}/version={number - 1}") if number else None
        memory.merge_history(stored, said(batch)).write.mode("overwrite").parquet(f"{root}/version={number}")
        done.append(number)

    rows = bus.file_stream(g.spark, os.path.join(g.folder, "conversations.parquet"))
    turns = rows.select(F.concat(F.lit("session:"), "conv_id").alias("session_id"), "turn", "text")
    bus.subscribe(turns, update, scratch_path(g.spark, "history-checkpoint")).awaitTermination()
    history = g.spark.read.parquet(f"{root}/version={max(done)}")
    return memory.session_summary(history).select("session_id", "summary", F.col("n").cast("bigint").alias("n"))


@query("w06_recent_turns", sql="""
SELECT session_id, turn, position::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS position FROM turns WHERE role = 'user') WHERE position <= 3""")
def recent_turns(g: Graph) -> DataFrame:
    rows = memory.recent_history(g.turns.filter("role = 'user'"), "session_id", [F.desc("turn")], 3)
    return rows.select("session_id", "turn", F.col("position").cast("bigint").alias("position"))


@query("w09_sentiment_trend", sql="""
SELECT person_id, strftime(tm, '%Y-%m-%d %H:%M:%S') AS at_time, sentiment_score FROM interaction WHERE tm IS NOT NULL AND type <> 'click'""")
def sentiment_trend(g: Graph) -> DataFrame:
    """(time, score) points of every person where both are known."""
    rows = g.interactions.withColumn("sentiment_score", F.when(F.col("type") != "click", F.col("sentiment_score")))
    points = rows.filter(F.col("at").isNotNull() & F.col("sentiment_score").isNotNull())
    return points.select("person_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "sentiment_score")


@query("t11_change_feed", sql="""
SELECT 'interactions' AS collection, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'relationships', count(*) FROM events""", graph=False)
def change_feed(g: Graph) -> DataFrame:
    """Change feed of a stream of interactions and their mentions, published as update events."""
    rows = event_stream(g)
    feed = rows.select(F.explode(F.array(
        F.struct(plural_label(F.lit("Interaction")).alias("collection"), F.concat(F.lit("interaction:"), "event_id").alias("key")),
        F.struct(F.lit("relationships").alias("collection"), F.concat_ws("|", "event_id", F.lit("MENTIONS"), "user_id").alias("key")))).alias("c")) \
        .select("c.*", F.lit("graph.update").alias("event_type"))
    return g.spark.read.parquet(bus.drain(feed, "feed")).groupBy("collection").agg(F.count("*").alias("n"))


@query("t12_sliding_windows", sql="""
WITH d AS (SELECT *, unnest(range(0, 14)) AS k FROM events), w AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS start, * FROM d),
g AS (SELECT start, start + INTERVAL 14 DAY AS stop, event_type, count(*) AS n FROM w GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, n::BIGINT AS n FROM g WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", graph=False)
def sliding_windows(g: Graph) -> DataFrame:
    """Fourteen-day windows sliding by a day, closed by the watermark."""
    counts = event_stream(g).withWatermark("ts", "1 day").groupBy(F.window("ts", "14 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = g.spark.read.parquet(bus.drain(counts.select(F.col("w.start").alias("start"), "event_type", "n"), "windows"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")
