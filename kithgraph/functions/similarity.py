"""Ratcliff-Obershelp similarity.  Spark has no built-in for it, so it is one Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.functions.text import non_empty, normalise_text, token_signature


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([
            0.0 if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)])


def ratio(left: Column, right: Column) -> Column:
    return F.coalesce(_ratio(left, right), F.lit(0.0))


def similarity(left: Column, right: Column) -> Column:
    """Better of the plain and the sorted-token ratio; 0 when either side is blank."""
    a, b = normalise_text(left), normalise_text(right)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.greatest(ratio(a, b), ratio(non_empty(token_signature(left)), non_empty(token_signature(right)))))
