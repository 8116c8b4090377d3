"""SQL rules and models given as text, whose failures stay with their row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSI = "spark.sql.ansi.enabled"


def with_isolated(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Add each SQL text as a column; where it cannot be evaluated for a row (a division by zero, an unreadable cast, a
    missing element) that row has null, and no other row or column is touched.

    The texts alone are analysed without ANSI errors, and the session's setting is back before this returns.  Whole numbers
    that overflow wrap in that mode: write amounts as decimals or doubles.  ``raise_error`` still ends a job, as it asks to.
    """
    if not texts:
        return df
    conf = df.sparkSession.conf
    before = conf.get(ANSI)
    conf.set(ANSI, "false")
    try:
        out = df.select("*", *[F.expr(t).alias(n) for n, t in texts.items()])
        out.schema  # analysed here, under this setting
        return out
    finally:
        conf.set(ANSI, before)
