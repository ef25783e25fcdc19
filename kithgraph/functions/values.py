"""Typed readings of loose values: time, sentiment, roles, statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.text import non_empty, strip


def flexible_timestamp(c: Column) -> Column:
    """ISO text, date, epoch seconds or epoch milliseconds (above 1e12); anything else is null."""
    text = strip(c.cast("string"))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000.0).otherwise(number)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, F.timestamp_micros((seconds * 1e6).cast("bigint")))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in columns])


def keyword_coalesce(names: Sequence[str], keywords: Sequence[str]) -> list[str]:
    """Property names holding one of the words, alphabetical; the order of a coalesce."""
    return sorted(n for n in names if any(k in n.lower() for k in keywords))


def is_closed(status: Column) -> Column:
    return F.coalesce(F.lower(strip(status)).isin(*model.CLOSED_STATUSES), F.lit(False))


def sentiment_score(score: Column, label: Column) -> Column:
    low = F.lower(label)
    return F.coalesce(
        score.try_cast("double"),
        F.when(low.contains("negative"), -1.0).when(low.contains("positive"), 1.0).when(low.contains("neutral"), 0.0))


def entity_category(labels: Column, stakeholder: Sequence[str], project: Sequence[str]) -> Column:
    def hit(names: Sequence[str]) -> Column:
        return F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))

    return F.when(hit(stakeholder), "stakeholder").when(hit(project), "project")


def preferred_label(labels: Column, preferred: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(p) for p in preferred])
    hit = F.filter(wanted, lambda p: F.array_contains(labels, p))
    return F.coalesce(F.get(hit, 0), F.get(labels, 0))


def role_type(props: Column) -> Column:
    return first_present(*[F.element_at(props, k) for k in ("role_type", "role", "roleType")])


def is_primary(props: Column) -> Column:
    def has(k: str) -> Column:
        return F.map_contains_key(props, k)

    return (F.when(has("is_primary"), F.element_at(props, "is_primary"))
            .when(has("primary"), F.element_at(props, "primary"))
            .otherwise(F.element_at(props, "isPrimary")))


def primary_id(own: Column, candidates: Column) -> Column:
    """Own id, else the id of the candidate with the highest confidence (first wins a tie)."""
    ranked = F.transform(candidates, lambda c, i: F.struct(c["confidence"].alias("conf"), (-i).alias("ord"),
                                                           c["id"].alias("id")))
    return F.coalesce(non_empty(own), F.array_max(F.filter(ranked, lambda c: non_empty(c["id"]).isNotNull()))["id"])


def valid_label(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))).rlike("^[A-Z][A-Za-z0-9_]*$")


def valid_relationship(c: Column) -> Column:
    return F.upper(c).rlike("^[A-Z0-9_]+$")


def clean_props(props: Column) -> Column:
    """Drop null values and the id; what is left may overwrite stored properties."""
    return F.map_filter(props, lambda k, v: v.isNotNull() & (k != "id"))


def age_days(as_of: Column, ts: Column) -> Column:
    micros = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def recency(as_of: Column, ts: Column) -> Column:
    return 1.0 / (1.0 + age_days(as_of, ts))


def rounded(c: Column, digits: int) -> Column:
    """The double rounded as C and Python print it: by its exact value, a tie to the even digit.  ``format_string`` rounds its shortest decimal form up.

    The remainder over the nearest half step is worked out on the two halves of the number's bits, so its sign is exact.
    """
    steps = 2.0 * 10 ** digits
    near = F.rint(c * steps)
    high = c * 134217729.0 - (c * 134217729.0 - c)
    rest = (high * steps - near) + (c - high) * steps
    low, up = (near - 1) / 2, (near + 1) / 2
    whole = F.when(near % 2 == 0, near / 2).when(rest < 0, low).when(rest > 0, up).when(low % 2 == 0, low).otherwise(up)
    size = F.abs(whole) / 10.0 ** digits
    return F.when(F.abs(c) < 1e9, F.when(c < 0, -size).otherwise(size)).otherwise(c)
