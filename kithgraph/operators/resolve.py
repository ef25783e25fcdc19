"""Entity resolution: candidates that carry a signal, scores, decisions, rewritten ids.

Equal work is done once: mentions are reduced to distinct profiles and candidates to distinct
signatures (the fields a score reads).  Candidates with one signature score alike against every
mention, so only as many of each as a decision can show are ever paired with a profile.

A candidate counts only with a score, so pairs come from the fields that give one: alike names, e-mails, phones and domains, and
contexts that alone reach the floor.  What may be a candidate at all is then asked of each pair.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions.text import domain_of, name_tokens, non_empty
from kithgraph.operators.alike import alike, alike_within, contained_alike, graded, piece_index, rarest_pieces, same_form
from kithgraph.session import stored

MENTION_FIELDS = ("name", "email", "phone", "domain", "org_id", "org_name", "org_domain")
CANDIDATE_FIELDS = ("name", "email", "phone", "domain", "org_id", "org_name", "org_domain")
#: Kinds of context by how few candidates share a value.
CONTEXT_KINDS = ("project", "document", "location", "org", "domain")
Thresholds = Mapping[str, Mapping[str, float]]


def with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def _key(fields: Sequence[str]) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})))


def profiles(mentions: DataFrame) -> DataFrame:
    fields = list(MENTION_FIELDS) + ["context_id"]
    full = with_columns(mentions, [*fields, "preview"])
    return full.withColumn("profile", _key(fields))


def signatures(candidates: DataFrame) -> DataFrame:
    return with_columns(candidates, CANDIDATE_FIELDS).withColumn("signature", _key(CANDIDATE_FIELDS))


def sides(mentions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles and signatures, written once: every kind of pair reads them."""
    return stored(profiles(mentions), "mentions"), stored(signatures(candidates), "candidates")


def distinct_profiles(mentions: DataFrame) -> DataFrame:
    """One row for each profile, written once: all that scores and decisions read of the mentions."""
    return stored(mentions.select("profile", *MENTION_FIELDS, "context_id").dropDuplicates(["profile"]), "profiles")


# --- candidates -------------------------------------------------------------------------

def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name) pairs of distinct lower-cased texts where the name contains the needle.

    A contained needle brings all of its three-letter pieces along, so each needle is looked up by its
    rarest piece only and then verified.  Needles shorter than three letters use their own length.
    """
    wanted = needles.select("needle").filter(F.coalesce("needle", F.lit("")) != "").distinct()
    index = piece_index(names)
    return rarest_pieces(wanted, index).join(index, "gram").filter(F.contains(F.col("name"), F.col("needle"))).select("needle", "name").distinct()


def _mention_domain(prefix: str = "") -> Column:
    return F.coalesce(domain_of(F.col(f"{prefix}domain")), domain_of(F.col(f"{prefix}email")))


def _candidate_domain(prefix: str = "") -> Column:
    return F.coalesce(domain_of(F.col(f"{prefix}domain")), domain_of(F.col(f"{prefix}email")), domain_of(F.col(f"{prefix}org_domain")))


def _ends(value: Column, tail: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(value), tail), F.lit(False))


def _asked_domain() -> Column:
    return F.coalesce(domain_of(F.col("m_email")), domain_of(F.col("m_domain")))


def allowed(category: str) -> Column:
    """Whether a candidate is offered to a mention at all; of a pair's fields, m_ and c_.

    Persons: name or one of its tokens contained, equal e-mail or phone, or an e-mail or organisation domain that
    ends in the mention's domain.  Projects: equal name.  Organisations: all, for mentions with a name or domain.
    """
    if category == "project":
        return F.coalesce(F.lower("m_name") == F.lower("c_name"), F.lit(False)) & (F.col("m_name") != "")
    if category == "org":
        return F.coalesce(non_empty("m_name"), non_empty("m_domain")).isNotNull()
    low = F.lower("c_name")
    named = F.contains(low, F.lower("m_name")) | F.exists(name_tokens(F.col("m_name")), lambda t: F.contains(low, t))
    reached = F.coalesce(F.lower("c_email") == F.lower("m_email"), F.lit(False)) | F.coalesce(F.col("c_phone") == F.col("m_phone"), F.lit(False))
    return F.coalesce(named, F.lit(False)) | reached | _ends(F.col("c_email"), _asked_domain()) | _ends(F.col("c_org_domain"), _asked_domain())


def fields_of(pairs: DataFrame, mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    m = mentions.select("profile", *[F.col(f).alias(f"m_{f}") for f in MENTION_FIELDS]).dropDuplicates(["profile"])
    c = candidates.select("signature", *[F.col(f).alias(f"c_{f}") for f in CANDIDATE_FIELDS]).dropDuplicates(["signature"])
    return pairs.join(m, "profile").join(c, "signature")


def _met(found: DataFrame, mentions: DataFrame, candidates: DataFrame, left: Column, right: Column) -> DataFrame:
    """Pairs of profiles and signatures whose values were found alike."""
    return (mentions.select("profile", left.alias("left")).distinct().join(found.select("left", "right"), "left")
            .join(candidates.select("signature", right.alias("right")).distinct(), "right").select("profile", "signature"))


def _values(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("value")).filter(non_empty("value").isNotNull())


def _suffixes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i))


def domain_pairs(mentions: DataFrame, candidates: DataFrame, category: str, thresholds: Thresholds, keep: int,
                 asked: DataFrame | None = None, offered: DataFrame | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    """Pairs by domain.

    A domain can belong to very many candidates.  Those that have nothing but the domain in common, or the domain and the
    organisation, score by its likeness alone, so the first ``keep`` of each by (likeness, id) are enough: any other one is beaten by all of them.
    Those with more in common have it in their key: an alike name, or a project, document or place.
    """
    found = alike(_values(mentions, _mention_domain()), _values(candidates, _candidate_domain()), model.threshold(category, "domain_similarity", thresholds))
    wanted = mentions.select("profile", "name", _mention_domain().alias("left"), F.coalesce(domain_of(F.col("email")), domain_of(F.col("domain"))).alias("tail")).distinct()
    offers = candidates.groupBy("signature", "name", _candidate_domain().alias("right"), F.lower("email").alias("email"), F.lower("org_domain").alias("org_domain")).agg(F.min("id").alias("id"))
    keys = wanted.select("left", "tail").distinct().join(found, "left").join(offers.drop("name"), "right")
    admits = F.lit(True) if category == "org" else _ends(F.col("email"), F.col("tail")) | _ends(F.col("org_domain"), F.col("tail"))
    admitted = keys.filter(admits).select("left", "tail", "signature", "sim", "id")

    def first(rows: DataFrame, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc(F.round("sim", 9)), "id")
        return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select(*key, "signature")

    parts = [wanted.join(first(admitted, "left", "tail"), ["left", "tail"])]
    if asked is not None and offered is not None:
        for kind in kinds:
            a, o = asked.filter(F.col("kind") == kind), offered.filter(F.col("kind") == kind).select("signature", F.col("value").alias("other")).distinct()
            same = alike(a.select("value"), o.select(F.col("other").alias("value")), model.threshold(category, f"{kind}_similarity", thresholds))
            own = wanted.join(a.select("profile", "value"), "profile").join(same.select(F.col("left").alias("value"), F.col("right").alias("other")), "value")
            held = admitted.join(o, "signature")
            parts.append(own.join(first(held, "left", "tail", "other") if kind == "org" else held.select("left", "tail", "other", "signature"), ["left", "tail", "other"]))
    if category == "person":
        # alike names that are not contained in one another, admitted by the domain
        tails = wanted.select("tail").filter(non_empty("tail").isNotNull()).distinct()
        ending = offers.select("signature", "name", F.explode(F.array("email", "org_domain")).alias("text")).filter(non_empty("text").isNotNull()) \
            .select("signature", F.col("name").alias("value"), F.explode(_suffixes(F.col("text"))).alias("tail")).join(tails, "tail", "left_semi").withColumnRenamed("tail", "key").distinct()
        asks = wanted.select("profile", F.col("name").alias("value"), F.col("tail").alias("key")).filter("value IS NOT NULL AND key IS NOT NULL")
        near = alike_within(asks.select("value", "key"), ending.select("value", "key"), model.threshold(category, "name_similarity", thresholds))
        parts.append(asks.withColumnRenamed("value", "left").join(near, ["left", "key"]).join(ending.withColumnRenamed("value", "right"), ["right", "key"]))
        # near but not equal domains, or ones that do not admit: only pairs that something else admits
        rest = wanted.join(keys.filter(~admits).select("left", "tail", "signature"), ["left", "tail"]).select("profile", "signature").distinct()
        parts.append(fields_of(rest, mentions, candidates).filter(allowed(category)))
    return reduce(DataFrame.unionByName, [x.select("profile", "signature") for x in parts])


def candidate_pairs(mentions: DataFrame, candidates: DataFrame, category: str, thresholds: Thresholds = model.MERGE_THRESHOLDS,
                    asked: DataFrame | None = None, offered: DataFrame | None = None, kinds: Sequence[str] = (),
                    limits: Mapping[str, float] = model.RESOLUTION_LIMITS, fields: Sequence[str] = ("domain", "email", "phone")) -> DataFrame:
    """Distinct (profile, signature) pairs of offered candidates with a score, or a context of ``kinds`` that may do without one.

    ``fields`` names those besides the name that both sides have at all.
    """
    m = mentions.select("profile", *MENTION_FIELDS).distinct()
    c = candidates.select("signature", "id", *CANDIDATE_FIELDS).distinct()
    if category == "project":
        parts = [m.select("profile", F.lower("name").alias("low")).join(c.select("signature", F.lower("name").alias("low")), "low").select("profile", "signature")]
    else:
        names = (_values(m, F.col("name")), _values(c, F.col("name")), model.threshold(category, "name_similarity", thresholds))
        # persons who are alike by name but not contained can only be offered by e-mail, phone or domain, and are found by those
        parts = [_met((alike if category == "org" else contained_alike)(*names), m, c, F.col("name"), F.col("name"))]
        if "domain" in fields:
            parts.append(domain_pairs(m, c, category, thresholds, int(limits["max_alternates"]) + 1, asked, offered, [k for k in kinds if k != "domain"]))
        if category == "person":
            for field in [f for f in ("email", "phone") if f in fields]:
                left, right = (F.lower(field), F.lower(field)) if field == "email" else (F.col(field), F.col(field))
                parts.append(m.select("profile", left.alias("v")).join(c.select("signature", right.alias("v")), "v").select("profile", "signature"))
                found = alike(_values(m, F.col(field)), _values(c, F.col(field)), model.threshold(category, f"{field}_similarity", thresholds))
                parts.append(_met(found.filter("left <> right"), m, c, F.col(field), F.col(field)))
    if asked is not None and offered is not None:
        parts += context_pairs(asked, offered, category, thresholds, limits, kinds)
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    return fields_of(pairs, m, c).filter(allowed(category)).select("profile", "signature")


def paired(mentions: DataFrame, candidates: DataFrame, category: str, thresholds: Thresholds = model.MERGE_THRESHOLDS, asked: DataFrame | None = None,
           offered: DataFrame | None = None, kinds: Sequence[str] = (), limits: Mapping[str, float] = model.RESOLUTION_LIMITS, **more) -> DataFrame:
    """``candidate_pairs``, written once: scores and contexts both read them."""
    return stored(candidate_pairs(mentions, candidates, category, thresholds, asked, offered, kinds, limits, **more), "pairs")


# --- scores -----------------------------------------------------------------------------

def own_context(mentions: DataFrame, context: DataFrame | None) -> DataFrame:
    """(profile, kind, value): the context of the preview and what the mention says of its own organisation and domain."""
    own = [("org", F.col("org_id")), ("org", F.col("org_name")), ("domain", domain_of(F.col("domain"))), ("domain", domain_of(F.col("org_domain"))), ("domain", domain_of(F.col("email")))]
    rows = mentions.select("profile", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in own])).alias("x")).select("profile", "x.*")
    if context is not None:
        mail = F.col("kind").isin("email", "domain")
        given = context.select("context_id", F.when(mail, "domain").otherwise(F.col("kind")).alias("kind"), F.when(mail, domain_of(F.col("value"))).otherwise(F.col("value")).alias("value"))
        rows = rows.unionByName(mentions.select("profile", "context_id").join(given, "context_id").select("profile", "kind", "value"))
    return rows.filter(non_empty("value").isNotNull()).distinct()


def offered_context(candidates: DataFrame, candidate_context: DataFrame | None) -> DataFrame:
    """(signature, id, kind, value); ``id`` is null where it holds for all candidates of the signature."""
    own = [("org", F.col("org_id")), ("org", F.col("org_name")), ("domain", domain_of(F.col("domain"))), ("domain", domain_of(F.col("email"))), ("domain", domain_of(F.col("org_domain")))]
    rows = candidates.select("signature", F.lit(None).cast("string").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in own])).alias("x"))
    rows = rows.select("signature", "id", "x.*")
    if candidate_context is not None:
        rows = rows.unionByName(candidates.select("signature", "id").join(candidate_context, "id").select("signature", "id", "kind", "value"))
    return rows.filter(non_empty("value").isNotNull()).distinct()


def _kind_pairs(weights: Mapping[str, float], kinds: Sequence[str], floor: float) -> list[tuple[str, ...]]:
    """One or two kinds of every least set of kinds that reaches the floor, the ones shared by fewer candidates first."""
    reaching = [s for n in range(1, len(kinds) + 1) for s in combinations(kinds, n) if sum(weights[k] for k in s) >= floor - 1e-9]
    least = [s for s in reaching if not any(set(o) < set(s) for o in reaching)]
    return sorted({tuple(sorted(s, key=CONTEXT_KINDS.index))[:2] for s in least})


def context_pairs(asked: DataFrame, offered: DataFrame, category: str, thresholds: Thresholds = model.MERGE_THRESHOLDS,
                  limits: Mapping[str, float] = model.RESOLUTION_LIMITS, kinds: Sequence[str] = CONTEXT_KINDS) -> list[DataFrame]:
    """Frames of (profile, signature) pairs whose contexts could reach the floor without any matched field.

    They must share two kinds of context (or one that is enough by itself), so both are in the join's key.
    """
    weights = model.CONTEXT_BONUS[category]
    keys = _kind_pairs(weights, [k for k in kinds if k in weights], limits["candidate_floor"])
    met, held = {}, {}
    for kind in sorted({k for key in keys for k in key}):
        a, o = asked.filter(F.col("kind") == kind), offered.filter(F.col("kind") == kind)
        found = alike(a.select("value"), o.select("value"), model.threshold(category, f"{kind}_similarity", thresholds))
        met[kind] = a.select("profile", F.col("value").alias("left")).join(found, "left").select("profile", F.col("right").alias(kind)).distinct()
        held[kind] = o.select("signature", F.col("value").alias(kind)).distinct()
    parts = []
    for key in keys:
        left = reduce(lambda x, k: x.join(met[k], "profile"), key[1:], met[key[0]])
        right = reduce(lambda x, k: x.join(held[k], "signature"), key[1:], held[key[0]])
        parts.append(left.join(right, list(key)).select("profile", "signature"))
    return parts


def scored_pairs(pairs: DataFrame, mentions: DataFrame, candidates: DataFrame, category: str,
                 thresholds: Thresholds = model.MERGE_THRESHOLDS, rules: Mapping[str, Mapping[str, float]] = model.RESOLUTION_RULES
                 ) -> DataFrame:
    """Base score and matched fields of each (profile, signature) pair; without any field the score is 0."""
    weight = rules.get(category, {})

    def least(key: str) -> Column:
        return F.lit(model.threshold(category, f"{key}_similarity", thresholds))

    fields = {f"{f}_sim": (F.col(f"m_{f}"), F.col(f"c_{f}"), least(f.split("_")[0])) for f in ("name", "email", "phone", "org_id", "org_name")}
    fields["domain_sim"] = (_mention_domain("m_"), _candidate_domain("c_"), least("domain"))
    rows = graded(fields_of(pairs, mentions, candidates), ["profile", "signature"], fields)
    rows = rows.withColumn("org_sim", F.when(F.col("org_id_sim") > 0, F.col("org_id_sim")).otherwise(F.col("org_name_sim")))
    named, with_org = F.col("name_sim") > 0, F.col("org_sim") > 0
    total = (weight.get("email_score", 1.0) * F.col("email_sim") + weight.get("phone_score", 1.0) * F.col("phone_sim")
             + F.when(named & with_org, weight.get("name_org_score", 0.0) * F.greatest("name_sim", "org_sim"))
             .when(named, weight.get("name_only_score", 0.0) * F.col("name_sim")).otherwise(0.0)
             + weight.get("domain_score", 0.0) * F.col("domain_sim") + weight.get("name_score", 0.0) * F.col("name_sim"))
    matched = F.array_compact(F.array(
        F.when(F.col("email_sim") > 0, "email"), F.when(F.col("phone_sim") > 0, "phone"),
        F.when(named & with_org, "name_org").when(named, "name"), F.when(F.col("domain_sim") > 0, "domain")))
    return rows.select("profile", "signature", total.alias("base_score"), matched.alias("matched_fields"), "name_sim", "org_sim",
                       "email_sim", "phone_sim", "domain_sim")


def context_hits(pairs: DataFrame, asked: DataFrame, offered: DataFrame, category: str, thresholds: Thresholds = model.MERGE_THRESHOLDS) -> DataFrame:
    """(profile, signature, id, kinds) of pairs whose contexts overlap; ``id`` is null where it holds for the whole signature.

    Both sides are rows, so a candidate with any number of projects is spread over tasks, and each
    distinct pair of values is compared once.
    """
    least = {kind: model.threshold(category, f"{kind}_similarity", thresholds) for kind in model.CONTEXT_BONUS[category]}
    met = [_context_values(pairs, asked, offered, [k for k in least if least[k] < 1.0], least), _equal_contexts(pairs, asked, offered, [k for k in least if least[k] >= 1.0])]
    return reduce(DataFrame.unionByName, [x for x in met if x is not None]).groupBy("profile", "signature", "id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _context_values(pairs: DataFrame, asked: DataFrame, offered: DataFrame, kinds: Sequence[str], least: Mapping[str, float]) -> DataFrame | None:
    """(profile, signature, id, kind) by a comparison of the values of both sides."""
    if not kinds:
        return None
    met = pairs.select("profile", "signature").join(asked.filter(F.col("kind").isin(*kinds)).withColumnRenamed("value", "left"), "profile") \
        .join(offered.withColumnRenamed("value", "right"), ["signature", "kind"])
    values = met.select("kind", "left", "right").distinct()
    found = graded(values, ["kind", "left", "right"], {"sim": (F.col("left"), F.col("right"), F.create_map(*[F.lit(x) for k in kinds for x in (k, least[k])])[F.col("kind")])})
    return met.join(found.filter("sim > 0").select("kind", "left", "right"), ["kind", "left", "right"]).select("profile", "signature", "id", "kind")


def _equal_contexts(pairs: DataFrame, asked: DataFrame, offered: DataFrame, kinds: Sequence[str]) -> DataFrame | None:
    """(profile, signature, id, kind) where only an equal value is a hit, which is in the join's key then: no other pair of values is formed."""
    if not kinds:
        return None
    wanted = pairs.select("profile", "signature").join(asked.filter(F.col("kind").isin(*kinds)).select("profile", "kind", same_form(F.col("value")).alias("form")).filter("form IS NOT NULL").distinct(), "profile")
    return wanted.join(offered.select("signature", "id", "kind", same_form(F.col("value")).alias("form")), ["signature", "kind", "form"]).select("profile", "signature", "id", "kind")


def bonus(kinds: Column, category: str) -> Column:
    """Each kind of context counts once."""
    weights = F.create_map(*[F.lit(x) for item in model.CONTEXT_BONUS[category].items() for x in item])
    return F.aggregate(kinds, F.lit(0.0), lambda total, k: total + weights[k])


def ranked_candidates(scored: DataFrame, candidates: DataFrame, category: str, hits: DataFrame | None = None,
                      limits: Mapping[str, float] = model.RESOLUTION_LIMITS) -> DataFrame:
    """Candidates at or above the floor, best first, as many as a decision shows."""
    keep = int(limits["max_alternates"]) + 1
    none = F.array().cast("array<string>")
    base = scored.select("profile", "signature", "base_score", "matched_fields")
    ids = candidates.select("signature", "id", F.col("org_id").alias("candidate_org"))
    first = ids.withColumn("__r", F.row_number().over(Window.partitionBy("signature").orderBy("id"))).filter(F.col("__r") <= keep).drop("__r")
    if hits is None:
        rows = base.withColumn("kinds", none).join(first, "signature")
    else:
        shared = hits.filter("id IS NULL").select("profile", "signature", F.col("kinds").alias("__all"))
        base = base.join(shared, ["profile", "signature"], "left").withColumn("__all", F.coalesce("__all", none))
        single = hits.filter("id IS NOT NULL").select("profile", "signature", "id", F.col("kinds").alias("__one"))
        rewarded = base.join(single, ["profile", "signature"]).join(ids, ["signature", "id"]).withColumn("kinds", F.array_sort(F.array_union("__all", "__one")))
        plain = base.join(first, "signature").join(single.select("profile", "id"), ["profile", "id"], "left_anti").withColumn("kinds", F.col("__all"))
        columns = ["profile", "signature", "id", "base_score", "matched_fields", "kinds", "candidate_org"]
        rows = plain.select(columns).unionByName(rewarded.select(columns))
    rows = rows.withColumn("bonus", bonus(F.col("kinds"), category)).withColumns({
        "score": F.col("base_score") + F.col("bonus"),
        "matched_fields": F.concat("matched_fields", F.transform("kinds", lambda k: F.concat(F.lit("context:"), k, F.lit("s"))))})
    rows = rows.filter((F.col("score") >= limits["candidate_floor"]) & ((F.col("score") > 0) | (F.size("matched_fields") > 0)))
    order = Window.partitionBy("profile").orderBy(F.desc(F.round("score", 9)), "id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)


def decide(mentions: DataFrame, ranked: DataFrame, category: str, limits: Mapping[str, float] = model.RESOLUTION_LIMITS,
           thresholds: Thresholds = model.MERGE_THRESHOLDS) -> DataFrame:
    """One decision per profile, also for profiles without candidates."""
    gap = model.threshold(category, "ambiguity_gap", thresholds, 0.0)
    best = ranked.groupBy("profile").agg(
        F.min_by("id", "position").alias("best_guess_id"), F.max("score").alias("confidence"),
        F.max(F.when(F.col("position") == 2, F.col("score"))).alias("second"), F.min_by("candidate_org", "position").alias("best_org"),
        F.array_sort(F.collect_list(F.struct("position", "id", "score", "matched_fields", "kinds"))).alias("identity_candidates"))
    rows = mentions.select("profile").distinct().join(best, "profile", "left")
    confidence = F.coalesce("confidence", F.lit(0.0))
    sure = F.col("best_guess_id").isNotNull() & (confidence >= limits["min_confidence"])
    status = F.when(sure & F.coalesce(confidence - F.col("second") <= gap, F.lit(False)), "multi_resolved").when(sure, "resolved").otherwise("new")
    level = F.when(confidence >= limits["high"], "high").when(confidence >= limits["medium"], "medium").otherwise("low")
    below = F.col("best_guess_id").isNotNull() & (confidence < limits["min_confidence"])
    reasons = F.array_compact(F.array(
        F.when(status.isin(*model.REVIEW_STATUSES), F.concat(F.lit("status:"), status)),
        F.when(level == "low", "confidence_below:medium"), F.when(below, f"confidence_below:{limits['min_confidence']}")))
    return rows.select(
        "profile", F.lit(category).alias("category"), F.when(sure, F.col("best_guess_id")).alias("canonical_id"), "best_guess_id",
        confidence.alias("confidence"), status.alias("resolution_status"), level.alias("confidence_level"),
        F.when(sure, F.col("best_org")).alias("best_org"), reasons.alias("review_reasons"), (F.size(reasons) > 0).alias("needs_review"),
        F.coalesce("identity_candidates", F.array().cast(
            "array<struct<position:int,id:string,score:double,matched_fields:array<string>,kinds:array<string>>>")).alias("identity_candidates"))


def resolve(mentions: DataFrame, candidates: DataFrame, category: str, context: DataFrame | None = None,
            candidate_context: DataFrame | None = None, thresholds: Thresholds = model.MERGE_THRESHOLDS,
            limits: Mapping[str, float] = model.RESOLUTION_LIMITS) -> DataFrame:
    """Resolved mention records of one category.

    ``context`` has (context_id, kind, value), ``candidate_context`` (id, kind, value); a mention's own organisation and domain
    are context too.  ``preview`` (null where there is none) tells apart mentions of different previews with one temp_id.
    """
    m, c = sides(mentions, candidates)
    p = distinct_profiles(m)
    asked, offered = own_context(p, context), offered_context(c, candidate_context)
    kinds = [k for k in CONTEXT_KINDS if k in ("org", "domain") or context is not None and candidate_context is not None]
    left, right = set(mentions.columns), set(candidates.columns)
    fields = [f for f in ("email", "phone") if f in left & right] + ["domain"] * bool(left & {"domain", "email"} and right & {"domain", "email", "org_domain"})
    pairs = paired(p, c, category, thresholds, asked, offered, kinds, limits, fields=fields)
    scored = scored_pairs(pairs, p, c, category, thresholds)
    hits = context_hits(pairs, asked, offered, category, thresholds)
    decisions = decide(p, ranked_candidates(scored, c, category, hits, limits), category, limits, thresholds)
    return records(m, decisions)


HISTORY = ("array<struct<status:string,canonical_id:string,best_guess_id:string,confidence:double,confidence_level:string,needs_review:boolean,"
           "candidates:array<struct<id:string,score:double>>>>")


def _entry(status: Column) -> Column:
    shown = F.transform("identity_candidates", lambda c: F.struct(c["id"].alias("id"), c["score"].alias("score")))
    return F.array(F.struct(status.alias("status"), "canonical_id", "best_guess_id", F.col("confidence").cast("double").alias("confidence"), "confidence_level",
                            "needs_review", shown.alias("candidates"))).cast(HISTORY)


def records(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mention rows with their decision: ids, alternates, and one more entry of their identity history."""
    joined = mentions.join(decisions, "profile")
    alternates = F.filter("identity_candidates", lambda c: F.col("canonical_id").isNull() | (c["id"] != F.col("canonical_id")))
    before = F.coalesce(F.col("identity_history").cast(HISTORY), F.array().cast(HISTORY)) if "identity_history" in mentions.columns else F.array().cast(HISTORY)
    return joined.withColumns({
        "id": F.coalesce("canonical_id", "temp_id"), "is_new": F.col("canonical_id").isNull(), "alternates": alternates,
        "org_id": F.when(non_empty("org_id").isNotNull() & non_empty("best_org").isNotNull(), F.col("best_org")).otherwise(F.col("org_id")),
        "identity_history": F.concat(before, _entry(F.col("resolution_status")))}).drop("best_org", "profile")


def resolution_log(resolved: DataFrame) -> DataFrame:
    """Everything but clean resolutions."""
    return resolved.filter((F.col("resolution_status") != "resolved") | F.col("needs_review")).select(
        "category", "temp_id", "canonical_id", "best_guess_id", "resolution_status", "confidence", "confidence_level", "needs_review",
        "review_reasons")


def id_map(*resolved: DataFrame) -> DataFrame:
    """(preview, temp_id, canonical_id): one id for each name within a preview.

    The frames come in the order of resolution; where a name was resolved more than once the last frame wins, and in a
    frame the greatest id.
    """
    parts = [r.filter(F.col("canonical_id").isNotNull() & F.col("temp_id").isNotNull()).select("preview", "temp_id", "canonical_id", F.lit(i).alias("step"))
             for i, r in enumerate(resolved)]
    return reduce(DataFrame.unionByName, parts).groupBy("preview", "temp_id").agg(F.max(F.struct("step", "canonical_id"))["canonical_id"].alias("canonical_id"))


def rewrite(rows: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ids by their canonical ones wherever the mapping knows them.

    A mapping with a ``preview`` only speaks for rows of that preview.  It has one row for each name, so rows never multiply.
    """
    keyed = "preview" in mapping.columns
    rows = with_columns(rows, ["preview"]) if keyed else rows
    for c in columns:
        known = mapping.select(F.col("temp_id").alias("__from"), F.col("canonical_id").alias("__to"), *([F.col("preview").alias("__preview")] if keyed else []))
        met = F.col(c) == F.col("__from")
        rows = rows.join(known, met & F.col("preview").eqNullSafe(F.col("__preview")) if keyed else met, "left")
        rows = rows.withColumn(c, F.coalesce("__to", c)).drop("__from", "__to", "__preview")
    return rows


def resolve_preview(orgs: DataFrame, persons: DataFrame, projects: DataFrame, relationships: DataFrame, candidates: Mapping[str, DataFrame],
                    **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """Organisations, then persons with the organisation ids rewritten, then projects, then the edges.

    What a stage returns is read several times by the next ones, so it is written once.
    """
    resolved = {"org": stored(resolve(orgs, candidates["org"], "org", **options), "org")}
    people = rewrite(persons, id_map(resolved["org"]), ["org_id"])
    resolved["person"] = stored(resolve(people, candidates["person"], "person", **options), "person")
    resolved["project"] = stored(resolve(projects, candidates["project"], "project", **options), "project")
    return resolved, rewrite(relationships, id_map(*resolved.values()), ["src", "dst"])


def reassign(resolved: DataFrame, mapping: DataFrame) -> DataFrame:
    """Delayed merge: replace ids in the records and their candidates, and note it in the history.

    The candidates of a record are a handful, so the ones to change are joined as rows and put back.
    """
    numbered = stored(resolved.withColumn("__row", F.monotonically_increasing_id()), "records")
    rows = rewrite(numbered, mapping, ["id", "canonical_id", "best_guess_id", "temp_id"])
    cells = numbered.select("__row", "preview", F.explode("identity_candidates").alias("c")).select("__row", "preview", "c.*")
    moved = rewrite(cells, mapping, ["id"]).groupBy("__row").agg(F.array_sort(F.collect_list(
        F.struct("position", "id", "score", "matched_fields", "kinds"))).alias("moved"))
    rows = rows.join(moved, "__row", "left").withColumn("identity_candidates", F.coalesce("moved", "identity_candidates")).drop("moved", "__row")
    return rows.withColumn("alternates", F.filter("identity_candidates", lambda c: F.col("canonical_id").isNull() | (c["id"] != F.col("canonical_id")))) \
        .withColumn("identity_history", F.concat("identity_history", _entry(F.lit("reassigned"))))
