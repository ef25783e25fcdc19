"""Values whose string similarity reaches a threshold, found without comparing all with all.

A ratio of matching blocks is at most twice the number of letters two texts have in common, over the sum of their lengths.  A text is
taken as its letters with their counts (the second ``e`` is a token of its own), so a threshold asks for a least number of common tokens, which
depends on the two lengths.  Of two texts that have it, each must hold one of the other's first tokens in a common order; they meet in an
equi-join on both lengths and such a token.  Edit distances are worked out in the JVM before a ratio is, once for each distinct pair.
Everything holds for both forms of a text, the plain one and the one of sorted tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.similarity import ratio
from kithgraph.functions.text import name_tokens, non_empty, normalise_text, token_signature
from kithgraph.session import stored

EPS = 1e-9
EDITED = 512  # letters of texts whose edit distance is worked out
WHOLE = 64  # letters of names that are met by what they hold as a whole
LIST = 4096  # names with one piece of text, up to which the list is read as a whole


def plain(c: Column) -> Column:
    return normalise_text(c)


def sorted_tokens(c: Column) -> Column:
    return non_empty(token_signature(c))


FORMS = (plain, sorted_tokens)


def same_form(c: Column) -> Column:
    """Equal for two values exactly if their similarity is 1: the sorted tokens, which equal plain texts share too, or a text without any."""
    return F.coalesce(sorted_tokens(c), plain(c))



#: Letters of a text with their running counts, high counts first: a set that stands for the multiset.
BAG = "transform(sort_array(transform(letters, (x, i) -> struct(i - array_position(letters, x) + 2 AS n, x AS letter)), false), t -> concat(t.n, t.letter))"


def possible(a: str, b: str, least: str) -> Column:
    """Whether two texts could reach a ratio; never null.  The arguments are SQL.

    What a ratio leaves unmatched must be taken out on both sides, which is never less than the edit distance.  Of very long
    texts only the lengths are judged.
    """
    both = f"(length({a}) + length({b}))"
    return F.expr(f"coalesce(2 * least(length({a}), length({b})) >= {least} * {both} - {EPS} AND (greatest(length({a}), length({b})) > {EDITED} "
                  f"OR levenshtein({a}, {b}) <= (1 - {least}) * {both} + {EPS}), false)")


def _forms(values: DataFrame, *more: str) -> DataFrame:
    """A row for each form of a value, with its text, length and letters."""
    forms = F.array(*[F.struct(F.lit(i).alias("form"), form(F.col("value")).alias("text")) for i, form in enumerate(FORMS)])
    return values.select("value", *more, F.explode(forms).alias("f")).selectExpr(
        "value", *more, "f.form", "f.text", "regexp_extract_all(f.text, '(?s).', 0) AS letters").filter("text IS NOT NULL") \
        .withColumn("letters", F.array_sort("letters")).selectExpr("value", *more, "form", "text", "length(text) AS size", f"{BAG} AS bag")


def _probes(forms: DataFrame, least: float, own: str, other: str) -> DataFrame:
    """A row for every length a partner may have and every token by which it must be met."""
    reach = (2.0 - least) / least
    return forms.withColumnRenamed("size", own).selectExpr("*", f"explode(sequence(int(ceil({own} / {reach} - {EPS})), int(floor({own} * {reach} + {EPS})))) AS {other}") \
        .selectExpr("*", f"{own} - int(ceil({least} * ({own} + {other}) / 2 - {EPS})) AS spare").filter("spare >= 0") \
        .selectExpr("*", "explode(slice(bag, 1, spare + 1)) AS token").drop("bag", "spare")


def _meeting(left: DataFrame, right: DataFrame, least: float, *keys: str) -> DataFrame:
    """Rows of both sides (value and further keys) that share a token either must be met by, with their texts a and b."""
    asks = _probes(_forms(left, *keys), least, "n", "m").withColumnsRenamed({"value": "left", "text": "a"})
    offers = _probes(_forms(right, *keys), least, "m", "n").withColumnsRenamed({"value": "right", "text": "b"})
    met = asks.join(offers, [*keys, "form", "n", "m", "token"]).select("left", "right", *keys, "a", "b").distinct()
    return met.filter((F.col("a") == F.col("b")) | possible("a", "b", f"{least}D"))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, sim) of all values (column ``value``) whose similarity is at least ``least``; blank values are like nothing."""
    met = _meeting(left.select("value").distinct(), right.select("value").distinct(), least)
    return met.select("left", "right", ratio(F.col("a"), F.col("b")).alias("sim")).groupBy("left", "right").agg(F.max("sim").alias("sim")).filter(F.col("sim") >= least)


def alike_within(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, key) of values that share a key and whose letters allow for ``least``; both sides have (value, key)."""
    return _meeting(left.select("value", "key").distinct(), right.select("value", "key").distinct(), least, "key").select("left", "right", "key").distinct()


# --- contained and alike ---------------------------------------------------------------------------

def grams(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n)))))


def rarest_pieces(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(needle, gram, df): of each needle the piece of at most three letters that the fewest names have; needles that nothing can hold are left out."""
    size = F.least(F.length("needle"), F.lit(3))
    seen_in = index.groupBy("gram").agg(F.count("*").alias("df"))
    pieces = needles.select("needle", F.explode(
        F.when(size == 1, grams(F.col("needle"), 1)).when(size == 2, grams(F.col("needle"), 2)).otherwise(grams(F.col("needle"), 3))).alias("gram"))
    return pieces.join(seen_in, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("gram"),
        F.min(F.coalesce("df", F.lit(0))).alias("df")).filter(F.col("df") > 0)


def piece_index(names: DataFrame) -> DataFrame:
    """(name, gram): every piece of one to three letters of distinct names."""
    return names.select("name").filter(F.col("name").isNotNull()).distinct().select("name", F.explode(F.flatten(F.filter(
        F.array(*[grams(F.col("name"), n) for n in (1, 2, 3)]), lambda a: a.isNotNull()))).alias("gram"))


def _by_whole(wanted: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(left, right) of wanted (value, needle) whose whole needle a name of at most ``WHOLE`` letters holds, met by the needle itself.

    What a value holds and is alike to is nearly as long, so a name only has few parts to be met by, and of these only those as long as a needle.
    """
    lengths = [r["n"] for r in wanted.select(F.length("needle").alias("n")).filter(F.col("n") <= WHOLE).distinct().collect()]
    size, shortest = F.length("name"), F.ceil(F.length(F.coalesce(sorted_tokens(F.col("right")), plain(F.col("right")))) * (least / (2.0 - least)) - EPS)
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: (n >= shortest) & (n <= size))
    parts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr("name", i, n))))
    return names.filter(size <= WHOLE).select("right", F.explode(F.array_distinct(parts)).alias("needle")).join(wanted, "needle").select(F.col("value").alias("left"), "right")


def _by_pieces(wanted: DataFrame, names: DataFrame, least: float, list_bound: int) -> DataFrame:
    """(left, right) of wanted (value, needle) whose needle a name holds, looked up by the rarest piece of the needle.

    A piece that many names have is not enough to be looked up by: there the lengths and the letters that alike texts must share belong to the key.
    """
    index = stored(piece_index(names), "pieces")  # read by the counts and by both kinds of lists
    rarest = stored(wanted.join(rarest_pieces(wanted.select("needle").distinct(), index), "needle"), "rarest")
    met = rarest.filter(F.col("df") <= list_bound).join(index, "gram").filter(F.contains("name", "needle")).select("value", "name")
    long = rarest.filter(F.col("df") > list_bound)
    if not long.isEmpty():
        common = index.join(long.select("gram").distinct(), "gram", "left_semi").withColumnRenamed("name", "value")
        close = _meeting(long.select("value", "gram").distinct(), common, least, "gram")
        needles = long.select(F.col("value").alias("left"), "gram", "needle")
        met = met.unionByName(close.join(needles, ["left", "gram"]).filter(F.contains("right", "needle")).select(F.col("left").alias("value"), F.col("right").alias("name")))
    return met.distinct().join(names, "name").select(F.col("value").alias("left"), "right")


def contained_alike(left: DataFrame, right: DataFrame, least: float, list_bound: int = LIST) -> DataFrame:
    """(left, right, sim) of values that are alike and where the right one holds the left one, or one of its tokens, in lower case.

    Values held as a whole are met by all of their letters.  Tokens, and what very long names hold, are looked up by their rarest piece.
    """
    left, right = left.select("value").distinct().filter(plain(F.col("value")).isNotNull()), right.select("value").distinct()
    names = right.select(F.col("value").alias("right"), F.lower("value").alias("name"))
    whole = left.select("value", F.lower("value").alias("needle"))
    tokens = left.select("value", F.explode(F.array_except(name_tokens(F.col("value")), F.array(F.lower("value")))).alias("needle"))
    pairs = _by_whole(whole, names, least)
    for wanted, held in ((whole, names.filter(F.length("name") > WHOLE)), (tokens, names)):
        if not (wanted.isEmpty() or held.isEmpty()):
            pairs = pairs.unionByName(_by_pieces(wanted, held, least, list_bound))
    return graded(pairs.distinct(), ["left", "right"], {"sim": (F.col("left"), F.col("right"), F.lit(least))}).filter("sim > 0")


# --- given pairs ------------------------------------------------------------------------------------

def graded(rows: DataFrame, keys: Sequence[str], fields: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Rows (unique by ``keys``) with a similarity for each field, 0 below the field's threshold.

    Null, equal and hopeless values are settled in the JVM; the rest is rated once for each distinct pair of texts.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), a.alias("x"), b.alias("y"), least.alias("least")) for name, (a, b, least) in fields.items()])
    forms = F.array(*[F.struct(form(F.col("x")).alias("a"), form(F.col("y")).alias("b")) for form in FORMS])
    asks = rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("x IS NOT NULL AND y IS NOT NULL") \
        .select(*keys, "field", "least", F.explode(forms).alias("f")).select(*keys, "field", "least", "f.a", "f.b").filter("a IS NOT NULL AND b IS NOT NULL")
    asks = asks.filter((F.col("a") == F.col("b")) | possible("a", "b", "least"))
    sims = asks.filter("a <> b").select("a", "b").distinct().select("a", "b", ratio(F.col("a"), F.col("b")).alias("sim"))
    rated = asks.join(sims, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(1.0))).filter("sim >= least")
    found = rated.groupBy(*keys).agg(*(F.max(F.when(F.col("field") == name, F.col("sim"))).alias(f"__{name}") for name in fields))
    return rows.join(found, list(keys), "left").withColumns({name: F.coalesce(F.col(f"__{name}"), F.lit(0.0)) for name in fields}).drop(*(f"__{name}" for name in fields))
