"""Text columns.  All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph import model

BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def non_empty(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalise_text(c: Column) -> Column:
    return non_empty(F.lower(strip(c)))


def words(c: Column) -> Column:
    """Whitespace tokens; an empty or blank text has none."""
    return F.filter(F.split(strip(c), r"\s+"), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    return words(F.regexp_replace(normalise_text(c), "[_-]", " "))


def token_signature(c: Column) -> Column:
    return F.array_join(F.array_sort(name_tokens(c)), " ")


def domain_of(c: Column) -> Column:
    """Part after the last ``@`` of an e-mail, else the whole text."""
    return F.substring_index(normalise_text(c), "@", -1)


def slug(c: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(non_empty(cleaned), F.lit("item"))


def attribute_id(c: Column) -> Column:
    token = F.array_join(words(F.regexp_replace(F.lower(c), "-", " ")), "_")
    return F.when(token != "", F.concat(F.lit("attr_"), token)).otherwise(F.lit("attr_unknown"))


def summary(c: Column, n_chars: int = 140) -> Column:
    return F.substring(c, 1, n_chars)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def truncate(c: Column, n: int = model.MEMORY["summary_chars"]) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def query_keywords(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[\w-]+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)))


def intent(keywords: Column) -> Column:
    def has(*names: str) -> Column:
        return F.arrays_overlap(keywords, F.array(*[F.lit(n) for n in names]))

    return (F.when(has("risk", "risks"), "risk")
            .when(has("summary", "summarise", "summarize"), "summary")
            .when(has("who", "owner"), "who").otherwise("search"))


def salient_phrases(c: Column) -> Column:
    """All tokens but the last, without filler words; duplicates stay."""
    cleaned = F.filter(F.transform(words(F.lower(c)), lambda t: F.btrim(t, F.lit(" ,.;:!?\t\n"))), lambda t: t != "")
    head = F.slice(cleaned, F.lit(1), F.greatest(F.size(cleaned) - 1, F.lit(0)))
    return F.filter(head, lambda t: ~t.isin(*model.PHRASE_STOPWORDS))


def json_salvage(c: Column) -> Column:
    """The outermost ``{...}`` of a text when it is valid JSON, else null."""
    body = non_empty(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def next_patch_version(c: Column, fallback: str = "0.0.1") -> Column:
    parts = F.split(c, r"\.")
    bumped = F.concat_ws(".", parts[0], parts[1], (parts[2].cast("bigint") + 1).cast("string"))
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), bumped).otherwise(F.lit(fallback))


def labelled_ref(label: Column, ident: Column) -> Column:
    return F.concat_ws(":", F.coalesce(non_empty(strip(label)), F.lit("Entity")), ident)


def embedding_text(fields: dict[str, Column]) -> Column:
    """Text a node is embedded by: the preferred fields, else every short text in key order."""
    def present(c: Column) -> Column:
        return non_empty(strip(c))

    preferred = [present(fields[k]) for k in model.TEXT_FIELD_ORDER if k in fields]
    short = [F.when(F.length(fields[k]) <= 280, present(fields[k])) for k in sorted(fields)]
    chosen = F.concat_ws("\n", *preferred) if preferred else F.lit("")
    return F.when(chosen != "", chosen).otherwise(F.concat_ws("\n", *short) if short else F.lit(""))


def context_values(key: str, fields: dict[str, Column], plural: Column | None = None) -> Column:
    """Values a context offers for one kind: the key itself, then its id/name/title forms, then the list."""
    scalars = [fields[k] for k in (key, f"{key}_id", f"{key}_name", f"{key}_title") if k in fields]
    base = F.filter(F.array(*[s.cast("string") for s in scalars]), lambda v: v.isNotNull() & (v != "")) \
        if scalars else F.array().cast("array<string>")
    return F.concat(base, F.filter(plural, lambda v: v.isNotNull() & (v != ""))) if plural is not None else base


def regex_quote(c: Column) -> Column:
    """Escape a phrase for use as a pattern."""
    return F.regexp_replace(c, r"([\\.^$*+?{}\[\]|()\-#&~\s])", r"\\$1")


def rel_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[- ]", "_"))


def plural_label(c: Column) -> Column:
    """Node label to collection key: snake case, then plural."""
    snake = F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))
    return (F.when(snake.endswith("y") & ~snake.endswith("ay"), F.regexp_replace(snake, "y$", "ies"))
            .when(snake.endswith("s"), snake).otherwise(F.concat(snake, F.lit("s"))))


def pascal(c: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(c, "-", "_"), "_"), lambda p: p != "")
    return F.array_join(F.transform(
        parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def collection_label(c: Column) -> Column:
    """Collection key to node label; concept collections all become Concept."""
    single = (F.when(c.endswith("ies"), F.regexp_replace(c, "ies$", "y"))
              .when(c.endswith("s"), F.regexp_replace(c, "s$", "")).otherwise(c))
    return F.when(is_concept_collection(c), F.lit("Concept")).otherwise(pascal(single))


def is_concept_collection(c: Column) -> Column:
    return c.rlike("(types|categories|groups|concepts)$")


def concept_kind(c: Column) -> Column:
    """Kind of a concept collection, e.g. ``risk_categories`` is RiskCategory."""
    low = F.lower(c)
    out = pascal(low)
    for suffix, word in (("_groups", "Group"), ("_categories", "Category"), ("_types", "Type")):
        out = F.when(low.endswith(suffix), F.concat(pascal(F.regexp_replace(low, suffix + "$", "")), F.lit(word))) \
            .otherwise(out)
    return out


def hierarchy_kind(c: Column) -> Column:
    """Kind of a concept file: last word made singular, then Pascal case."""
    single = (F.when(c.rlike("ies$") & (F.length(c) > 3), F.regexp_replace(c, "ies$", "y"))
              .when(c.rlike("ses$") & (F.length(c) > 3), F.regexp_replace(c, "es$", ""))
              .when(c.rlike("s$") & ~c.rlike("ss$"), F.regexp_replace(c, "s$", "")).otherwise(c))
    return pascal(single)


def keyword_any(c: Column, keywords: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of the words."""
    low = F.lower(c)
    cond = F.lit(False)
    for k in keywords:
        cond = cond | low.contains(k)
    return cond
