"""Schemas, rules and reference lists, and how they become DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------------------
# They must equal the ones users of the engine already rely on.
# --------------------------------------------------------------------------------------

# Node labels, the concept kind of each, and the observed properties.
NODE_TYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "Agent": ("AgentProfile", ("created_by", "name", "role", "source_uri", "updated_by")),
    "Commitment": ("CommitmentType", ("due_date", "name", "owner_id", "relates_to_contract_id",
                                      "relates_to_project_id", "source_uri", "status", "text")),
    "Concept": ("Form", ("description", "kind", "metadata", "name", "source_uri")),
    "Contract": ("ContractType", ("end_date", "name", "org_ids", "sap_id", "source_uri", "start_date", "value")),
    "Interaction": ("InteractionType", ("at", "sentiment", "source_uri", "summary", "type")),
    "Issue": ("IssueCategory", ("category", "description", "raised_in_interaction_id", "related_risk_ids",
                                "relates_to_project_ids", "relates_to_topic_ids", "severity", "source_uri",
                                "status", "title")),
    "Org": ("OrgCategory", ("alternates", "category", "confidence", "domain", "identity_candidates",
                            "identity_history", "name", "resolution_status", "sector", "source_uri", "temp_id")),
    "Outcome": ("OutcomeType", ("associated_project_ids", "description", "realised_date", "results_from_risk_ids",
                                "source_uri", "title", "type")),
    "Person": ("StakeholderType", ("alternates", "confidence", "email", "identity_candidates", "identity_history",
                                   "influence_score", "name", "org_id", "resolution_status", "source_uri",
                                   "temp_id", "title", "type")),
    "Project": ("ProjectType", ("alternates", "confidence", "identity_candidates", "identity_history", "name",
                                "resolution_status", "source_uri", "status", "temp_id")),
    "Risk": ("RiskCategory", ("category", "description", "identified_in_interaction_id", "impact", "likelihood",
                              "relates_to_project_ids", "relates_to_topic_ids", "results_in_outcome_ids", "score",
                              "source_uri", "status", "title")),
    "Topic": ("TopicGroup", ("name", "source_uri")),
}

# Relationship types.
RELATIONSHIP_TYPES = (
    "ASSISTS", "ASSOCIATED_WITH", "IDENTIFIED_IN", "INFLUENCES", "INSTANCE_OF", "INVOLVED_IN", "INVOLVES", "MADE",
    "MENTIONS", "PARTICIPATED_IN", "PARTY_TO", "RAISED_IN", "RELATED_TO", "RELATES_TO", "RESULTS_IN", "RESULT_OF",
    "WORKS_FOR",
)

# Keywords that put a label or relationship type into a role group.
LABEL_ROLE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "person": ("person",), "org": ("org", "organisation", "organization"), "project": ("project",),
    "commitment": ("commitment",), "issue": ("issue",), "risk": ("risk",), "interaction": ("interaction",),
    "topic": ("topic",), "contract": ("contract",), "alert": ("alert",),
}
RELATIONSHIP_ROLE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "involved_in": ("involved",), "works_for": ("works_for", "worksfor"),
}
REASONING_RELATIONSHIP_KEYWORDS = (
    "mention", "made", "request", "relates", "related", "influence", "raised", "identified", "result", "associate",
    "participated", "involved", "party", "work", "assist",
)
PATH_TARGET_ROLES = ("risk", "issue", "commitment", "project", "contract", "topic", "person", "org")
STAKEHOLDER_KEYWORDS = ("person", "org", "stakeholder", "agent")

# Commitment statuses.
CLOSED_STATUSES = ("done", "closed", "cancelled", "resolved")
RESOLVED_STATUSES = ("accepted", "done")
OVERDUE_EXCLUDED_STATUSES = ("done", "cancelled")

# Property name -> (relationship, target label, allowed source labels).
PROPERTY_RELATIONSHIPS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "org_id": ("WORKS_FOR", "Org", ("Person",)),
    "org_ids": ("PARTY_TO", "Org", ("Contract",)),
    "owner_id": ("MADE", "Person", ("Commitment",)),
    "relates_to_project_id": ("RELATES_TO", "Project", ("Commitment",)),
    "relates_to_contract_id": ("RELATES_TO", "Contract", ("Commitment",)),
    "relates_to_topic_ids": ("RELATED_TO", "Topic", ("Issue", "Risk")),
    "relates_to_project_ids": ("RELATED_TO", "Project", ("Issue", "Risk")),
    "related_risk_ids": ("RELATED_TO", "Risk", ("Issue",)),
    "results_in_outcome_ids": ("RESULTS_IN", "Outcome", ("Risk",)),
    "results_from_risk_ids": ("RESULT_OF", "Risk", ("Outcome",)),
    "associated_project_ids": ("ASSOCIATED_WITH", "Project", ("Outcome",)),
    "raised_in_interaction_id": ("RAISED_IN", "Interaction", ("Issue",)),
    "identified_in_interaction_id": ("IDENTIFIED_IN", "Interaction", ("Risk",)),
}

# Similarity thresholds of entity resolution.
MERGE_THRESHOLDS: dict[str, dict[str, float]] = {
    "defaults": {"name_similarity": 0.85, "org_similarity": 0.85, "domain_similarity": 0.95, "email_similarity": 0.97,
                 "phone_similarity": 0.98, "project_similarity": 0.8, "document_similarity": 0.8,
                 "location_similarity": 0.7, "ambiguity_gap": 0.1, "concept_similarity": 0.75},
    "org": {"name_similarity": 0.85, "domain_similarity": 0.95, "project_similarity": 0.7, "location_similarity": 0.7},
    "person": {"name_similarity": 0.85, "org_similarity": 0.85, "email_similarity": 0.97, "phone_similarity": 0.98,
               "project_similarity": 0.7, "document_similarity": 0.8, "location_similarity": 0.7},
    "project": {"name_similarity": 0.9, "location_similarity": 0.7},
}

# Score weights, decision limits and context bonuses of entity resolution.
RESOLUTION_RULES: dict[str, dict[str, float]] = {
    "org": {"name_score": 0.9, "domain_score": 1.0},
    "person": {"email_score": 1.0, "phone_score": 1.0, "domain_score": 0.7, "name_org_score": 0.92,
               "name_only_score": 0.6},
    "project": {"name_score": 0.9},
}
RESOLUTION_LIMITS = {"min_confidence": 0.9, "candidate_floor": 0.5, "max_alternates": 3, "high": 0.9, "medium": 0.6}
REVIEW_STATUSES = ("ambiguous", "unresolved", "multi_resolved")
CONTEXT_BONUS: dict[str, dict[str, float]] = {
    "org": {"project": 0.25, "document": 0.15, "location": 0.1, "domain": 0.15, "org": 0.25},
    "person": {"project": 0.25, "document": 0.15, "location": 0.1, "domain": 0.2, "org": 0.25},
    "project": {"project": 0.2, "document": 0.15, "location": 0.15, "domain": 0.1, "org": 0.15},
}

# Concept assignment settings.
ASSIGNMENT = {"embedding_similarity_threshold": 0.2, "decision_threshold": 0.4, "ambiguity_gap": 0.1,
              "embedding_weight": 0.85, "structural_weight": 0.1, "lexical_weight": 0.05, "dimensions": 24,
              "candidate_limit": 5}
PHRASE_STOPWORDS = ("a", "an", "the", "very", "quite")

# Stakeholder types and risk categories.
CONCEPTS: tuple[tuple[str, str, str, str, str, tuple[str, ...]], ...] = (
    # concept_key, id, name, description, form_id, applies_to
    ("stakeholder_types", "st_supplier", "Supplier", "External organisation providing goods or services.",
     "form_stakeholder", ("Org",)),
    ("stakeholder_types", "st_regulator", "Regulator", "Government or regulatory authority.",
     "form_stakeholder", ("Org",)),
    ("stakeholder_types", "st_community_rep", "Community Representative", "Community or public representative.",
     "form_stakeholder", ("Person",)),
    ("stakeholder_types", "st_internal_sponsor", "Internal Sponsor", "Internal leader accountable for outcomes.",
     "form_stakeholder", ("Person",)),
    ("risk_categories", "rc_schedule", "Schedule", "Schedule and timeline risks.", "form_risk", ()),
    ("risk_categories", "rc_commercial", "Commercial", "Commercial or contractual exposure.", "form_risk", ()),
    ("risk_categories", "rc_reputation", "Reputation", "Reputation and stakeholder trust impacts.", "form_risk", ()),
    ("risk_categories", "rc_esg", "ESG", "Environmental, social, or governance risks.", "form_risk", ()),
)

# Contradiction rules.
HARD_CONSTRAINTS = {"HAS_SSN": (1, "identity_conflict"), "OWNS": (1, "cardinality_conflict")}
SOFT_CONSTRAINTS = {"WORKS_WITH": "value_disagreement", "INTERESTED_IN": "value_disagreement"}
TEMPORAL_RULES = {"OWNS": "temporal_overlap"}
PARADOX_ALLOWLIST = (("STATE", "Concept:schrodinger_cat"),)

# Alert rules and path policy.
ALERT_WINDOW_DAYS = 14
OVERDUE_GRACE_DAYS = 7
MIN_MODEL_SCORE = 0.6
FEATURE_KEYS = ("path_length", "recency", "sentiment_slope", "commitment_age", "influence_centrality")
OUTCOMES = ("acknowledged", "materialised", "false_positive")
OUTCOME_OF_STATUS = {"acknowledged": "acknowledged", "closed": "materialised", "ignored": "false_positive"}
RETRAIN_THRESHOLD = 25
ARCHIVE_LIMIT = 25
TRAINING = {"epochs": 300, "learning_rate": 0.08, "l2": 0.001}

# Memory limits.
MEMORY = {"short_ttl": 3600, "short_cap": 100, "short_promotion": 0.7, "mid_ttl": 604800, "increment": 1.0,
          "mid_strength": 3.0, "mid_importance": 0.85, "history": 5, "summary_chars": 2000, "batch": 50}

# Activation graph of the event router.
ACTIVATION = {
    "threshold": 0.45, "damping": 0.85, "steps": 2,
    "base": {"module.belief_prior_adjuster": 0.2, "module.ontology_proposal_summariser": 0.2,
             "module.learning_signal_router": 0.2},
    "edges": (("module.belief_prior_adjuster", "module.learning_signal_router", 0.2),
              ("module.ontology_proposal_summariser", "module.learning_signal_router", 0.25),
              ("module.learning_signal_router", "module.belief_prior_adjuster", 0.15)),
    "allowed_pipelines": ("pipeline.concept_update", "pipeline.reasoning_alerts"),
    "allowed_modules": ("module.learning_signal_router",),
}

# Mention patterns and the obligation lexicon.
PERSON_PATTERN = r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"
ORG_PATTERN = (r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+"
               r"(?:Pty Ltd|Pty|Ltd|LLC|Inc|Corporation|Corp|Company))\b")
OBLIGATION_PATTERNS = (
    (r"\b(?:will|shall)\b[^.]*?\bby\s+[^\.\n]+", True),
    (r"will\ send\ the\ report\ to\ Acme\ Pty\ Ltd\ by\ 2023\-09\-30", False),
    (r"will\ deliver\ the\ SOC2\ report\ by\ 30\ Sep", False),
)

# Words that route a feedback correction by its path.
CORRECTION_ROUTES = {
    "obligation": ("commitment", "obligation", "due_date", "deadline"),
    "synonym": ("name", "label", "title", "summary"),
    "confidence": ("confidence", "similarity", "score"),
    "concept": ("concept", "topic", "type"),
}
FEEDBACK_LIMIT = 50
FEEDBACK_THRESHOLD = 2

DRIFT_THRESHOLD = 0.15
TEXT_FIELD_ORDER = ("name", "title", "summary", "description", "text", "content", "kind", "type")

# --------------------------------------------------------------------------------------
# Rules as DataFrames (S05).  Their size is the length of the list, so the broadcast hint
# is safe; lists beyond the bound come back unhinted.
# --------------------------------------------------------------------------------------

RULE_ROWS_BOUND = 10_000


def rule_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    data = [tuple(r) for r in rows]
    df = spark.createDataFrame(data, schema)
    return F.broadcast(df) if len(data) <= RULE_ROWS_BOUND else df


def keyword_matches(names: Iterable[str], keywords: Iterable[str]) -> list[str]:
    keywords = tuple(keywords)
    return [n for n in names if any(k in n.lower() for k in keywords)]


def label_groups(labels: Iterable[str] = tuple(NODE_TYPES)) -> dict[str, list[str]]:
    labels = list(labels)
    return {role: keyword_matches(labels, kws) for role, kws in LABEL_ROLE_KEYWORDS.items()}


def reasoning_relationships(types: Iterable[str] = RELATIONSHIP_TYPES) -> list[str]:
    return keyword_matches(types, REASONING_RELATIONSHIP_KEYWORDS)


def id_properties(keyword: str, types: Mapping[str, tuple[str, tuple[str, ...]]] = NODE_TYPES) -> list[str]:
    """Property names that hold an id of the given kind."""
    names = {p for _, props in types.values() for p in props}
    return sorted(p for p in names if keyword in p.lower() and "id" in p.lower())


def threshold(category: str, key: str, thresholds: Mapping[str, Mapping[str, float]] = MERGE_THRESHOLDS,
              default: float = 1.0) -> float:
    return float(thresholds.get(category, {}).get(key, thresholds.get("defaults", {}).get(key, default)))


def concept_table(spark: SparkSession) -> DataFrame:
    return rule_table(
        spark, CONCEPTS,
        "concept_key string, id string, name string, description string, form_id string, applies_to array<string>")


def relationship_rules(spark: SparkSession) -> DataFrame:
    rows = [(p, rel, target, list(src)) for p, (rel, target, src) in PROPERTY_RELATIONSHIPS.items()]
    return rule_table(spark, rows, "prop string, rel string, target_label string, source_labels array<string>")


def label_roles(spark: SparkSession) -> DataFrame:
    rows = [(role, label) for role, labels in label_groups().items() for label in labels]
    return rule_table(spark, rows, "role string, label string")


def lexicon_table(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [(i, p, ci) for i, (p, ci) in enumerate(OBLIGATION_PATTERNS)],
                      "pattern_id int, regex string, ignore_case boolean")
