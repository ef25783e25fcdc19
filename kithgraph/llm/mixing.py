"""Mixing sources to target weights by entropy balancing.  Built-in functions only.

Each source has a word target.  A document of x words (in units of its source's mean) is taken at the rate

    w(x) = cap / (1 + (cap - 1) exp(-u x)),

the rates nearest to 1 in (bounded) entropy whose words add up to the target; 0 < w < cap.  The multiplier u of each source
solves a convex dual in one unknown.  Newton's method runs for all sources at once as Spark aggregations over the
counts of (source, size), and keeps a bracket so that it cannot run away.  A source whose target is ``cap`` times its
words is at the bound: rate ``cap``.

Rates become copies by their whole part plus a draw of their fraction with a hash of the document, so reruns agree.
What the draws miss is mended by single documents: round after round each source gives or takes a copy of the largest
document that fits into what it still misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import written
from kithgraph.operators.numbering import global_positions

WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 200
TOLERANCE = 1e-6
MENDS = 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts as sources do, in code point order with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("s"), size_of(F.col(text_col)).alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to (s, words): weights repeat over the sources in order; they share all words, but no source gets more than
    ``cap`` times its own: the excess is shared again by weight."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = written(global_positions(sources, [F.col("s").asc()])
                     .withColumn("weight", F.get(cycle, ((F.col("position") - 1) % len(weights)).cast("int"))), "mix-sources")
    total = placed.agg(F.sum("words")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # every round fills a source at least, or is the last
        over = (F.col("weight") * level) > F.col("words") * cap
        state = placed.agg(F.sum(F.when(over, F.col("words") * cap)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("free"),
                           F.sum(over.cast("long")).alias("full")).first()
        if not state["free"] or state["full"] == full:
            break
        full, level = state["full"], (total - (state["fixed"] or 0)) / state["free"]
    return placed.select("s", "words", F.least(F.col("words") * cap, F.col("weight") * level).cast("double").alias("target"))


def rate(u: Column, x: Column, cap: int = CAP) -> Column:
    return F.lit(float(cap)) / (1.0 + (cap - 1.0) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -u * x))))


def multipliers(counts: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``u`` to the goals (s, words, target, mean) by Newton's method on the dual; null where the rate is ``cap`` or 0."""
    inner = (F.col("target") > 0) & (F.col("target") < F.col("words") * cap * (1 - 1e-9))
    none = F.lit(None).cast("double")
    now = written(goals.select("*", F.when(inner, F.lit(0.0)).alias("u"), none.alias("low"), none.alias("high"), (~inner).alias("done")), "mix-dual")
    u = F.col("u")
    for _ in range(ROUNDS):
        if not now.filter(~F.col("done")).limit(1).count():
            return now.drop("low", "high", "done")
        x = F.col("size") / F.col("mean")
        words, w = F.col("n") * F.col("size"), rate(u, x, cap)
        sums = (counts.join(now.filter(~F.col("done")).select("s", "u", "mean"), "s")
                .groupBy("s").agg(F.sum(words * w).alias("got"), F.sum(words * x * w * (1 - w / cap)).alias("slope")))
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, u).otherwise(F.col("low")), F.when(gap > 0, u).otherwise(F.col("high"))
        newton = u - gap / F.col("slope")
        wide = F.when(low.isNull(), F.least(2 * high, F.lit(-1.0))).when(high.isNull(), F.greatest(2 * low, F.lit(1.0))).otherwise((low + high) / 2)
        safe = ((F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - u) <= 4 + F.abs(u)))
        settled = (F.abs(gap) <= TOLERANCE * F.col("target")) | (high - low <= 1e-12 * (1 + F.abs(u)))
        stay = F.col("done") | F.coalesce(settled, F.col("got").isNull())
        now = written(now.join(sums, "s", "left").select(
            "s", "words", "target", "mean", F.when(stay, u).when(safe, newton).otherwise(wide).alias("u"),
            F.when(stay, F.col("low")).otherwise(low).alias("low"), F.when(stay, F.col("high")).otherwise(high).alias("high"), stay.alias("done")), "mix-dual")
    raise RuntimeError("the mixing dual did not settle")


def drawn(cap: int = CAP) -> Column:
    """Copies of a row before mending, from id, s, size, u, mean, target and words."""
    w = F.when(F.col("u").isNotNull(), rate(F.col("u"), F.col("size") / F.col("mean"), cap)).when(F.col("target") > 0, float(cap)).otherwise(0.0)
    dice = F.pmod(F.xxhash64("id", "s", "size"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (F.floor(w) + (dice < w - F.floor(w)).cast("long")).cast("long")


def mends(rows: DataFrame, goals: DataFrame, cap: int = CAP, rounds: int = MENDS) -> DataFrame:
    """(s, id, size, delta): single documents that give or take a copy, at most ``rounds`` for each source.

    Documents are first reduced to one giver and one taker for each (source, size), so a round reads that small table.
    Rows that agree in id, source and size move together.
    """
    each = rows.groupBy("s", "id", "size").agg(F.count("*").alias("n"), F.first("copies").alias("copies"))
    order = F.struct(F.xxhash64("id", "size"), "id")
    spots = written(each.groupBy("s", "size", "n").agg(
        F.sum(F.col("n") * F.col("size") * F.col("copies")).alias("got"),
        F.min_by("id", F.when(F.col("copies") < cap, order)).alias("taker"), F.max(F.col("copies") < cap).alias("takes"),
        F.max_by("id", F.when(F.col("copies") > 0, order)).alias("giver"), F.max(F.col("copies") > 0).alias("gives")), "mix-spots")
    missing = written(goals.join(spots.groupBy("s").agg(F.sum("got").alias("got")), "s").select("s", (F.col("target") - F.col("got")).alias("gap")), "mix-gaps")
    picked = spots.select("s", F.col("taker").alias("id"), "size", "n", F.lit(0).cast("long").alias("delta")).limit(0)
    for _ in range(rounds):
        step = F.col("n") * F.col("size")
        fits = (step > 0) & (step <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("takes")).otherwise(F.col("gives"))
        free = spots.join(picked.select("s", "size", "n"), ["s", "size", "n"], "left_anti")
        best = (free.join(missing, "s").filter(fits).groupBy("s")
                .agg(F.max_by(F.struct(F.when(F.col("gap") > 0, F.col("taker")).otherwise(F.col("giver")).alias("id"), "size", "n",
                                       F.signum("gap").cast("long").alias("delta")), F.struct(step, "n")).alias("p")))
        new = written(best.select("s", "p.*"), "mix-picks")
        if not new.limit(1).count():
            break
        moved = new.select("s", (F.col("n") * F.col("size") * F.col("delta")).alias("moved"))
        missing = written(missing.join(moved, "s", "left").select("s", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap")), "mix-gaps")
        picked = written(picked.unionByName(new), "mix-picked")
    return picked.select("s", "id", "size", "delta")


def solve(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Goals (s, words, target, mean, u) and mends for a written table of (id, s, size)."""
    counts = written(rows.groupBy("s", "size").agg(F.count("*").alias("n")), "mix-counts")
    own = counts.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("words"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    goals = targets(own.select("s", "words"), weights, cap).join(own.select("s", "mean"), "s")
    goals = multipliers(counts, goals, cap)
    return goals, mends(rows.join(goals, "s").withColumn("copies", drawn(cap)), goals, cap)


def with_copies(rows: DataFrame, goals: DataFrame, mended: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds words, target and copies to rows that have id, s and size.  Both tables are small where sources are few; the planner knows their
    size and joins by shuffle, splitting a hot source, where they are not."""
    some = mended.select(F.col("s").alias("m_s"), F.col("id").alias("m_id"), F.col("size").alias("m_size"), "delta")
    joined = rows.join(goals, "s").withColumn("copies", drawn(cap))
    same = (F.col("s") == F.col("m_s")) & (F.col("size") == F.col("m_size")) & F.col("id").eqNullSafe(F.col("m_id"))
    return (joined.join(some, same, "left").withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0)))
            .drop("m_s", "m_id", "m_size", "delta", "mean", "u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(id, s, size, words, target, copies) for each row: its words, its source's words and target, and how often the mix takes it.

    Null texts have size 0; rows without words take no words whatever their copies.  Null sources are one source, the last.  Rows that
    agree in id, source and size are taken equally often.  A source without words has target 0.  An empty table gives an empty table.
    """
    rows = written(sized(docs, id_col, text_col, source_col), "mix-rows")
    return with_copies(rows, *solve(rows, weights, cap), cap)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Texts are not shuffled where sources are few."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-rows")
    goals, mended = solve(rows, weights, cap)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    own = docs.select(whole, F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("s"), size_of(F.col(text_col)).alias("size"))
    taken = with_copies(own, goals, mended, cap).filter("copies > 0")
    return taken.select(F.explode(F.array_repeat("whole", F.col("copies").cast("int"))).alias("whole")).select("whole.*")
