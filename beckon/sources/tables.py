"""Parquet tables as the engine reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from beckon.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table with zone-less timestamps taken as UTC instants.

    The scan is given the instant type directly, so filters on time columns still
    reach Parquet (a cast above the scan would block the pushdown).  The files are listed
    anew at every call.
    """
    configure(spark)
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path).schema
    fields = [
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in found.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)
