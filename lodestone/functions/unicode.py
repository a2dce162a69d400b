"""Compatibility folding, which no built-in function offers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(c: Column) -> Column:
    """NFKC. Only texts with characters beyond ASCII are sent to Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)
