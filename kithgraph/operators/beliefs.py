"""Beliefs derived from edges, their evidence, and contradictions between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions import ids
from kithgraph.functions.text import labelled_ref, non_empty
from kithgraph.session import stored


@dataclass(frozen=True)
class Rules:
    hard: Mapping[str, tuple[int, str]] = field(default_factory=lambda: dict(model.HARD_CONSTRAINTS))
    soft: Mapping[str, str] = field(default_factory=lambda: dict(model.SOFT_CONSTRAINTS))
    temporal: Mapping[str, str] = field(default_factory=lambda: dict(model.TEMPORAL_RULES))
    paradox: Sequence[tuple[str | None, str | None]] = model.PARADOX_ALLOWLIST


def beliefs_from_edges(edges: DataFrame, correlation_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Beliefs and supporting evidence, one of each per edge.

    Edges: src, rel, dst, src_label, dst_label, confidence (text or number), source_uri.
    """
    subject = labelled_ref(F.col("src_label"), F.col("src"))
    obj = labelled_ref(F.col("dst_label"), F.col("dst"))
    event = (correlation_id if correlation_id is not None else F.lit(None)).cast("string")
    beliefs = edges.select(
        ids.belief_id(subject, F.col("rel"), obj, F.lit("unknown")).alias("id"), subject.alias("subject_ref"), F.col("rel").alias("predicate"),
        obj.alias("object_ref"), F.col("dst_label").alias("object_label"), F.lit("unknown").alias("polarity"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)).alias("confidence"), "source_uri", event.alias("event_id"))
    evidence = beliefs.select(F.concat(F.lit("evidence_"), "id").alias("id"), F.col("id").alias("belief_id"), F.lit("supports").alias("relation_type"),
                              "event_id", "source_uri", "confidence")
    return beliefs, evidence


def preview_edges(relationships: DataFrame, mentions: DataFrame) -> DataFrame:
    """Preview relationships with the labels their mentions' collections imply.

    Mentions: interaction_id, collection, id, canonical_id, temp_id, name; the first filled one is the key.
    """
    single = F.regexp_replace("collection", "s$", "")
    label = F.concat(F.upper(F.left(single, F.lit(1))), F.lower(F.substr(single, F.lit(2))))
    key = F.coalesce(*[non_empty(c) for c in ("id", "canonical_id", "temp_id", "name")])
    known = mentions.select("interaction_id", key.alias("key"), label.alias("label")).groupBy("interaction_id", "key").agg(F.max("label").alias("label"))
    src = known.select("interaction_id", F.col("key").alias("src"), F.col("label").alias("src_label"))
    dst = known.select("interaction_id", F.col("key").alias("dst"), F.col("label").alias("dst_label"))
    return relationships.join(src, ["interaction_id", "src"], "left").join(dst, ["interaction_id", "dst"], "left")


def contradiction_markers(lines: DataFrame) -> DataFrame:
    """Markers of dialectical lines that name both ends."""
    both = lines.filter((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))
    return both.select(F.lit("dialectical_contradiction").alias("type"), "src", "dst", F.coalesce(non_empty("rel"), F.lit("CONTRADICTS")).alias("rel"),
                       F.coalesce("source_uri", "interaction_source").alias("source_uri"))


def upsert_beliefs(existing: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """Creation time is kept, everything else overwritten; a zero or missing confidence is stored as 0.5."""
    new = fresh.groupBy("id").agg(F.max_by(F.struct("subject_ref", "predicate", "object_ref", "confidence"), F.struct("confidence", "source_uri")).alias("n"))
    confidence = F.when(F.coalesce(F.col("n.confidence"), F.lit(0.0)) == 0.0, 0.5).otherwise(F.col("n.confidence"))
    old = existing.select("id", *[F.col(c).alias(f"o_{c}") for c in ("subject_ref", "predicate", "object_ref", "confidence", "created_at", "updated_at")])
    both = old.join(new, "id", "full")
    touched = F.col("n").isNotNull()
    return both.select(
        "id", *[F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in ("subject_ref", "predicate", "object_ref")],
        F.when(touched, confidence).otherwise(F.col("o_confidence")).alias("confidence"), F.coalesce("o_created_at", as_of).alias("created_at"),
        F.when(touched, as_of).otherwise(F.col("o_updated_at")).alias("updated_at"))


def about_links(beliefs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ABOUT edges to the entities a belief names, when they exist and are not beliefs."""
    # ids that end in a digest travel as its bytes
    digested = F.coalesce(F.col("id").rlike(r"[0-9a-f]{16}\z"), F.lit(False))
    packed = [F.when(digested, F.expr("substring(id, 1, length(id) - 16)")).otherwise(F.col("id")).alias("head"), F.when(digested, F.unhex(F.substring("id", -16, 16))).alias("digest")]
    refs = beliefs.select("id", F.explode(F.array("subject_ref", "object_ref")).alias("ref")).filter(F.contains("ref", F.lit(":")))
    named = refs.select(*packed, F.expr("substring(ref, instr(ref, ':') + 1)").alias("entity_id")).filter(F.col("entity_id") != "")
    known = nodes.filter(F.col("label") != "Belief").select(F.col("id").alias("entity_id"))
    # links meet their entity first, so what is equal lies together already and is not sent again
    held = named.join(known, "entity_id", "left_semi").distinct()
    return held.select(F.concat("head", F.coalesce(F.lower(F.hex("digest")), F.lit(""))).alias("src"), F.lit("ABOUT").alias("rel"), F.col("entity_id").alias("dst"))


def support_links(evidence: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SUPPORTS edges from the event if there is one, else from an evidence node; a null source keeps the old one."""
    by_event = F.coalesce("event_id", F.lit("")) != ""
    links = evidence.select(
        F.when(by_event, "Event").otherwise("Evidence").alias("src_label"),
        F.when(by_event, F.col("event_id")).otherwise(F.coalesce(non_empty("id"), F.concat(F.lit("evidence_"), "belief_id"))).alias("src"),
        F.lit("SUPPORTS").alias("rel"), F.col("belief_id").alias("dst"), "source_uri",
        F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, 0.5).otherwise(F.col("confidence")).alias("confidence"))
    key = ["src_label", "src", "rel", "dst"]
    merged = links.groupBy(*key).agg(F.max("source_uri").alias("source_uri"), F.max("confidence").alias("confidence"))
    if existing is None:
        return merged
    old = existing.select(*key, F.col("source_uri").alias("old_source"))
    return merged.join(old, key, "left").withColumn("source_uri", F.coalesce("source_uri", "old_source")).drop("old_source")


def statement_fields(rows: DataFrame) -> DataFrame:
    """Flat fields first, then those inside the JSON statement; the object falls back to its value."""
    def inside(path: str) -> Column:
        return non_empty(F.get_json_object("statement", path))

    return rows.withColumns({
        "subject_ref": F.coalesce("subject_ref", inside("$.subject.ref")), "predicate": F.coalesce(non_empty("predicate"), inside("$.predicate")),
        "object_ref": F.coalesce("object_ref", inside("$.object.ref"), F.get_json_object("statement", "$.object.value")),
        "object_label": F.coalesce(inside("$.object.label"), inside("$.object.type"))})


def _rules_table(df: DataFrame, rules: Rules) -> DataFrame:
    predicates = sorted(set(rules.hard) | set(rules.soft) | set(rules.temporal))
    rows = [(p, p in rules.hard and rules.hard[p][0] == 1, rules.hard.get(p, (0, None))[1] or "cardinality_conflict",
             rules.soft.get(p) or ("value_disagreement" if p in rules.soft else None), rules.temporal.get(p)) for p in predicates]
    return model.rule_table(df.sparkSession, rows, "predicate string, single boolean, hard_code string, soft_code string, temporal_code string")


def _paradox(subject: Column, predicate: Column, rules: Rules) -> Column:
    """Allow-list test; an entry that names nothing matches everything."""
    cond = F.lit(False)
    for p, s in rules.paradox:
        cond = cond | ((predicate == p if p else F.lit(True)) & (subject == s if s else F.lit(True)))
    return F.coalesce(cond, F.lit(False))


def contradictions(new: DataFrame, existing: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every contradicting pair of a new and an existing belief with equal subject and predicate.

    One row per contradiction, which is what the caller asked for; use ``conflict_counts`` when a
    subject may carry more beliefs than its pairs can be written out.
    """
    known = existing.join(new.select("id").distinct(), "id", "left_anti")
    n = new.filter(non_empty("subject_ref").isNotNull() & non_empty("predicate").isNotNull()).alias("n")
    e = known.alias("e")
    pairs = n.join(e, [F.col("n.subject_ref") == F.col("e.subject_ref"), F.col("n.predicate") == F.col("e.predicate")])
    joined = pairs.join(_rules_table(new, rules).alias("r"), F.col("n.predicate") == F.col("r.predicate"), "left")
    differ = ~F.col("n.object_ref").eqNullSafe(F.col("e.object_ref"))
    both = (F.col("n.object_ref") != F.col("e.object_ref")) & (F.col("n.object_ref") != "") & (F.col("e.object_ref") != "")
    overlap = (F.col("r.temporal_code").isNotNull() & (F.col("n.start_at") <= F.col("e.end_at"))
               & (F.col("e.start_at") <= F.col("n.end_at")) & differ)
    code = (F.when(overlap, F.col("r.temporal_code")).when(F.col("r.single") & both, F.col("r.hard_code"))
            .when(F.col("n.object_label") != F.col("e.object_label"), "type_mismatch").when(both & F.col("r.soft_code").isNotNull(), F.col("r.soft_code")))
    hard = F.coalesce(overlap, F.lit(False)) | F.coalesce(F.col("r.single") & both, F.lit(False))
    kind = F.when(_paradox(F.col("n.subject_ref"), F.col("n.predicate"), rules), "paradoxical").when(hard, "hard").otherwise("soft")
    return joined.select(F.col("n.id").alias("new_id"), F.col("e.id").alias("existing_id"), F.col("n.subject_ref").alias("subject_ref"),
                         F.col("n.predicate").alias("predicate"), F.col("n.object_ref").alias("new_object"), F.col("e.object_ref").alias("existing_object"),
                         code.alias("code"), kind.alias("type")).filter(F.col("code").isNotNull())


#: Order of what happens at one instant: a window that starts with another's end, or ends with its start, overlaps it.
STARTS, ASKS_END, ASKS_START, ENDS = range(4)


def _sweep(asks: DataFrame, spans: DataFrame, keys: Sequence[str], sums: Sequence[tuple[str, Sequence[str], str]]) -> DataFrame:
    """Distinct asks (keys, start_at, end_at) with numbers of overlapping spans, one for each of ``sums``.

    A sum is (name, the keys it runs within, SQL condition on the spans it counts).  Overlapping = started by my end, less ended before my
    start; both are running sums over signed events in the order of instants.  Equal events are added up first, so a
    key has a row for each of its instants, and all sums run within one exchange by their first two keys.  Windows that end before they start
    overlap nothing.
    """
    def marks(frame: DataFrame, start: int, end: int, *more: str) -> DataFrame:
        both = F.array(F.struct(F.col("start_at").alias("at"), F.lit(start).alias("phase")), F.struct(F.col("end_at").alias("at"), F.lit(end).alias("phase")))
        return frame.filter("start_at <= end_at").select(*keys, *more, F.explode(both).alias("m")).select(*keys, *more, "m.*")

    asks = asks.select(*keys, "start_at", "end_at").filter("start_at <= end_at").distinct()
    events = marks(spans, STARTS, ENDS).groupBy(*keys, "at", "phase").agg(F.count("*").alias("n"))
    points = marks(asks, ASKS_START, ASKS_END, "start_at", "end_at").withColumn("n", F.lit(0).cast("bigint"))
    rows = events.unionByName(points, allowMissingColumns=True).repartition(*keys[:2])
    started, ended = F.col("phase") == STARTS, F.col("phase") == ENDS

    def running(within: Sequence[str], condition: str) -> F.Column:
        order = Window.partitionBy(*within).orderBy("at", "phase").rowsBetween(Window.unboundedPreceding, 0)
        counted = F.when(F.expr(condition), F.col("n")).otherwise(0)
        until = F.sum(F.when(started, counted).otherwise(0)).over(order)
        before = F.sum(F.when(ended, counted).otherwise(0)).over(order)
        return F.when(F.col("phase") == ASKS_END, until).otherwise(-before)

    found = rows.select(*keys, "start_at", "end_at", "phase", *[running(within, condition).alias(name) for name, within, condition in sums])
    return found.filter(F.col("phase").isin(ASKS_END, ASKS_START)).groupBy(*keys, "start_at", "end_at").agg(*[F.sum(name).alias(name) for name, *_ in sums])


def overlap_counts(new: DataFrame, existing: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Per new belief the number of existing ones with equal keys whose closed window overlaps its own; windows are of dates or of instants."""
    keys = list(keys)
    filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    found = _sweep(new.filter(filled), existing.filter(filled), keys, [(name, keys, "true")])
    return new.join(found, [*keys, "start_at", "end_at"], "left").na.fill({name: 0})


def key_counts(new: DataFrame, existing: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    counts = existing.groupBy(*keys).agg(F.count("*").alias(name))
    return new.join(counts, list(keys), "left").na.fill({name: 0})


FEW = 500_000  # hashes of ids that are broadcast


def _not_renewed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows whose id no new row has.

    Hashes of the ids tell which rows could have one; mostly few can, and then only these meet by their ids and no row is sent anywhere.
    """
    def code(df: DataFrame) -> DataFrame:
        return df.filter("id IS NOT NULL").select(F.xxhash64("id").alias("h"))

    both = stored(code(existing).join(code(new), "h", "left_semi").distinct(), "renewed")
    if both.limit(FEW + 1).count() > FEW:
        return existing.join(new.select("id").distinct(), "id", "left_anti")
    hashed, either = existing.withColumn("h", F.when(F.col("id").isNotNull(), F.xxhash64("id"))), F.broadcast(both)
    again = new.join(either, F.xxhash64(new["id"]) == F.col("h"), "left_semi").select("id").distinct()
    return hashed.join(either, "h", "left_anti").drop("h").unionByName(hashed.join(either, "h", "left_semi").drop("h").join(again, "id", "left_anti"))


def conflict_counts(new: DataFrame, existing: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per new belief the number of contradictions of each code, without forming the pairs.

    Everything is a sum over the existing beliefs of a subject and predicate, or those of them with an equal object or label, and of the overlapping
    windows a running sum; pairs with another object are those of the group less those of the same, and so on.  Both sides are sent once, by subject and
    predicate, and all sums run there.  A null or empty object is no conflict of values, but differs from others in time.  Every row of ``new`` has its
    own counts, repeated ids included.
    """
    group, statement = ["subject_ref", "predicate"], ["subject_ref", "predicate", "object_ref", "object_label"]
    columns = ["id", *statement, "start_at", "end_at"]
    new = new.select(*columns)
    named = reduce(lambda a, b: a & b, [non_empty(c).isNotNull() for c in group])
    known = _not_renewed(existing.filter(named).select(*columns), new).drop("id")
    valid, labelled = "coalesce(object_ref, '') <> ''", "object_label IS NOT NULL"
    # (name, within, condition): all of the group, those with a value, those of the same object; each of any label, with a label, of the same label
    sums = [("all", group, "true"), ("all_l", group, labelled), ("all_s", [*group, "object_label"], labelled),
            ("val", group, valid), ("val_l", group, f"{valid} AND {labelled}"), ("val_s", [*group, "object_label"], f"{valid} AND {labelled}"),
            ("own", [*group, "object_ref"], "true"), ("own_l", [*group, "object_ref"], labelled), ("own_s", statement, labelled)]
    rows = new.withColumn("row", F.monotonically_increasing_id()).unionByName(known, allowMissingColumns=True).repartition(*group)
    old, zero = F.col("row").isNull(), F.lit(0).cast("bigint")
    has_value, has_label = non_empty("object_ref").isNotNull(), F.col("object_label").isNotNull()

    def other(kind: str, label: bool = False, prefix: str = "") -> F.Column:
        """Pairs that differ in time (all) or in value (val): of any label, or with another label."""
        def count(which: str) -> F.Column:
            name = f"{prefix}{which}"
            return F.col(name) if not label else F.when(has_label, F.col(f"{name}_l") - F.col(f"{name}_s")).otherwise(zero)

        rest = count(kind) - count("own")
        return F.when(has_value, rest).otherwise(zero) if kind == "val" else rest

    totals = [F.sum(F.when(old & F.expr(condition), 1).otherwise(0)).over(Window.partitionBy(*within)).alias(name) for name, within, condition in sums]
    timed = F.coalesce(F.col("predicate").isin(*rules.temporal) & (F.col("start_at") <= F.col("end_at")), F.lit(False))
    rows = rows.select(*columns, "row", *totals).filter(~old | timed).select(
        *columns, "row", F.col("all").alias("n_pairs"), F.when(has_label, F.col("all_l") - F.col("all_s")).otherwise(zero).alias("mismatch"),
        other("val").alias("values"), other("val", label=True).alias("apart"))
    marks = F.when(timed, F.array(F.struct(F.col("start_at").alias("at"), F.when(old, STARTS).otherwise(ASKS_START).alias("phase")),
                                  F.struct(F.col("end_at").alias("at"), F.when(old, ENDS).otherwise(ASKS_END).alias("phase"))))
    rows = rows.select("*", F.explode_outer(marks).alias("m")).select("*", "m.at", "m.phase").drop("m")

    def running(within: Sequence[str], condition: str) -> F.Column:
        order = Window.partitionBy(*within).orderBy("at", "phase").rowsBetween(Window.unboundedPreceding, 0)
        until, before = (F.sum(F.when((F.col("phase") == phase) & F.expr(condition), 1).otherwise(0)).over(order) for phase in (STARTS, ENDS))
        return F.when(F.col("phase") == ASKS_END, until).when(F.col("phase") == ASKS_START, -before).otherwise(zero)

    kept = ["id", *statement, "n_pairs", "mismatch", "values", "apart"]
    rows = rows.select(*kept, "row", *[running(within, condition).alias(f"t_{name}") for name, within, condition in sums]).filter("row IS NOT NULL")
    rows = rows.groupBy("row", *kept).agg(*[F.sum(f"t_{name}").alias(f"t_{name}") for name, *_ in sums])
    rows = rows.join(_rules_table(new, rules), "predicate", "left")
    single = F.coalesce("single", F.lit(False))
    apart = F.col("apart") - other("val", label=True, prefix="t_")
    mismatch = F.col("mismatch") - other("all", label=True, prefix="t_") - F.when(single, apart).otherwise(zero)
    values = F.col("values") - other("val", prefix="t_")
    return rows.select(
        "id", "subject_ref", "predicate", "object_ref", "n_pairs", other("all", prefix="t_").alias("n_temporal"),
        F.when(single, values).otherwise(zero).alias("n_cardinality"), mismatch.alias("n_type_mismatch"),
        F.when(~single & F.col("soft_code").isNotNull(), values - apart).otherwise(zero).alias("n_disagreement"),
        _paradox(F.col("subject_ref"), F.col("predicate"), rules).alias("paradoxical"))


def counts_by_type(counts: DataFrame) -> DataFrame:
    """Hard, soft and paradoxical contradictions with their total."""
    hard, soft = F.col("n_temporal") + F.col("n_cardinality"), F.col("n_type_mismatch") + F.col("n_disagreement")
    return counts.agg(
        F.coalesce(F.sum(F.when(~F.col("paradoxical"), hard)), F.lit(0)).alias("hard"),
        F.coalesce(F.sum(F.when(~F.col("paradoxical"), soft)), F.lit(0)).alias("soft"),
        F.coalesce(F.sum(F.when(F.col("paradoxical"), hard + soft)), F.lit(0)).alias("paradoxical"),
        F.coalesce(F.sum(hard + soft), F.lit(0)).alias("total"))


def contradiction_graph(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contradiction nodes, INVOLVES edges per belief and the tension edge between the two."""
    ident = F.concat(F.lit("contradiction_"), F.substring(F.sha2(F.concat_ws("|", "code", "new_id", "existing_id"), 256), 1, 16))
    keyed = pairs.withColumn("id", ident)
    nodes = keyed.select("id", "type", "code", "predicate").distinct()
    involves = keyed.select(F.col("id").alias("src"), F.lit("INVOLVES").alias("rel"),
                            F.posexplode(F.array("new_id", "existing_id")).alias("position", "dst")).distinct()
    tension = keyed.select(F.col("new_id").alias("src"), F.lit("DIALECTICAL_TENSION").alias("rel"), F.col("existing_id").alias("dst"),
                           F.col("id").alias("contradiction_id")).distinct()
    return nodes, involves, tension
