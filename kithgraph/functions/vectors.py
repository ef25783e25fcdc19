"""Vector columns over ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.text import strip, words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in a body; lambdas would otherwise work it out per element."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Length of a vector, 1.0 for the zero vector."""
    return F.coalesce(F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, held to [-1, 1]; an empty vector gives 0."""
    n = F.least(F.size(a), F.size(b))
    value = cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def signed_byte(digest: Column, position: Column) -> Column:
    """Byte of a hex digest mapped to [-1, 1]."""
    return F.conv(F.substr(digest, position * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0


def token_embedding(text: Column, dims: int = 24) -> Column:
    """Sum over the tokens of their digest bytes, scaled to unit length."""
    digests = F.transform(words(F.lower(text)), lambda t: F.sha2(t, 256))
    raw = let(digests, lambda hs: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.aggregate(hs, F.lit(0.0), lambda acc, h: acc + signed_byte(h, i % 32))))
    return unit(raw)


def text_embedding(text: Column, dims: int = 32) -> Column:
    digest = F.sha2(F.lower(strip(text)), 256)
    return unit(let(digest, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: signed_byte(h, i % 32))))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean per group, as one array.

    The mean is a partial aggregate per (group, position), so a hot group is reduced on the
    map side; only the width of the vector is ever gathered in one row.
    """
    cells = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("cells"))
    return gathered.select(*keys, F.transform("cells", lambda c: c["m"]).alias("centroid"))
