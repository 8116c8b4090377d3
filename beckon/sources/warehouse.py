"""Reading the warehouse and writing exports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts
from beckon.operators.timeline import equal_depth, split_row_number

# literals, quoted names and comments, each as a whole, or a placeholder outside of them
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\{(\w+)\}", re.S)
_NAME = re.compile(r"\{(\w+)\}")


def bind(sql: str) -> tuple[str, set[str]]:
    """The text with ``{name}`` placeholders as ``:name`` arguments, and their names.

    A placeholder that is a whole literal keeps its value's type; one within a longer literal joins its text to the rest;
    comments and quoted names are left alone.
    """
    names: set[str] = set()

    def argument(name: str) -> str:
        names.add(name)
        return f":{name}"

    def token(m: re.Match) -> str:
        text = m.group(0)
        if m.group(1):
            return argument(m.group(1))
        if text[0] not in "'\"" or not _NAME.search(text):
            return text
        quote, inner = text[0], text[1:-1]
        parts = _NAME.split(inner)  # text, name, text, name, ..., text
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return argument(parts[1])
        pieces = [f"cast({argument(p)} as string)" if k % 2 else f"{quote}{p}{quote}" for k, p in enumerate(parts) if p]
        return f"concat({', '.join(pieces)})"

    return _TOKEN.sub(token, sql), names


def warehouse_scan(spark: SparkSession, sql: str, params: Mapping[str, object], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a configured query with ``{name}`` parameters bound as typed SQL arguments, see ``bind``.

    Values are bound, never pasted into the text; filters reach the Parquet scan.  ``tables`` become
    session views of their names.
    """
    text, wanted = bind(sql)
    missing = wanted - set(params)
    if missing:
        raise ValueError(f"missing query parameters: {sorted(missing)}")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args={k: params[k] for k in wanted})


def stringify_rows(df: DataFrame) -> DataFrame:
    """Every value as text; null stands for an absent key."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def program_source(
    df: DataFrame, condition: Column, constants: Mapping[str, object], flags: Mapping[str, Column], done: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Qualifying rows plus program constants and flags, minus pairs already answered."""
    out = df.filter(condition)
    if done is not None:
        out = out.join(done.select(*keys).distinct(), list(keys), "left_anti")
    return out.withColumns({**{n: F.lit(v) for n, v in constants.items()}, **dict(flags)})


def stamp_provenance(df: DataFrame, job: str, execution: str, stage: str, as_of) -> DataFrame:
    """Processing time, job, execution and stage columns."""
    return df.withColumns(
        {"processed_at": as_ts(as_of), "job_name": F.lit(job), "execution_id": F.lit(execution), "stage": F.lit(stage)}
    )


def export_day(df: DataFrame, program: str, date: str, program_col: Column, created: Column, updated: Column) -> DataFrame:
    """S10 selection: the program's rows created or updated on one UTC day."""
    start = F.lit(date).cast("timestamp")
    end = start + F.expr("INTERVAL '1' DAY")
    hit = lambda c: (c >= start) & (c < end)
    picked = df.filter((program_col == program) & (hit(created) | hit(updated)))
    return picked.withColumns({"program": program_col, "date": F.lit(date)})


def write_export(df: DataFrame, path: str) -> int:
    """S10 sink: Parquet under ``program=/date=``; an empty selection writes nothing and returns 0."""
    if df.isEmpty():
        return 0
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program", "date").parquet(path)
    return seen.get["rows"]


def paged_extract(df: DataFrame, key: str, page_size: int, bucket: Column | None = None, max_pages: int | None = None) -> DataFrame:
    """Page number of each row in key order; ``bucket`` is a coarse ascending code of the key.

    Without one the key (a number or time) is cut into ranges of equal depth.  Offsets come from
    per-range counts, so no task sees the whole table and what is added up in sequence does not grow with it.
    """
    limit = None if max_pages is None else page_size * max_pages
    codes = [bucket] if bucket is not None else list(equal_depth(df, key))
    ranked = split_row_number(df, [], [F.asc(key)], codes, "row_no", limit)
    return ranked.withColumn("page_no", F.floor((F.col("row_no") - 1) / F.lit(page_size)).cast("bigint"))
