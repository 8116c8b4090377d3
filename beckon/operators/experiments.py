"""Deterministic experiment assignment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.hashing import java_hash_bucket, sha_bucket
from beckon.schema import TREATMENT, ddl


@dataclass(frozen=True)
class Experiment:
    """Groups are (treatment id, allocation percent) in order."""

    id: str
    groups: Sequence[tuple[str, int]] = field(default_factory=tuple)
    enabled: bool = True
    start: str | None = None
    end: str | None = None


# sample configuration used by the registered queries
SAMPLE_EXPERIMENTS = (
    Experiment("exp-1", (("control", 50), ("variant", 50))),
    Experiment("exp-2", (("a", 40), ("b", 30), ("c", 30))),
    Experiment("exp-3", (("control", 100),), enabled=False),
    Experiment("exp-4", (("control", 45), ("variant", 45))),
)


def pick_group(bucket: Column, groups: Sequence[tuple[str, int]]) -> Column:
    """The group whose cumulative allocation covers the bucket; the last one beyond the sum."""
    out, high = None, 0
    for name, share in groups:
        high += share
        cond = bucket < high
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(groups[-1][0]))


def assign_treatment(customer: Column, experiment: Experiment) -> Column:
    """Null for disabled or empty experiments."""
    if not experiment.enabled or not experiment.groups:
        return F.lit(None).cast("string")
    return pick_group(sha_bucket(F.concat(customer, F.lit(f":{experiment.id}"))), experiment.groups)


def ab_variant(customer: Column, groups: Sequence[tuple[str, int]]) -> Column:
    """Variant by Java string hash."""
    return pick_group(java_hash_bucket(customer), groups)


def assign_treatments(customers: DataFrame, experiments: Sequence[Experiment], customer: str = "customer_id") -> DataFrame:
    """One row per customer and active experiment, exploded from configuration (no join)."""
    live = [e for e in experiments if e.enabled and e.groups]
    pairs = F.array(*[F.struct(F.lit(e.id).alias("experiment_id"), assign_treatment(F.col(customer), e).alias("treatment_id")) for e in live])
    return customers.withColumn("__t", F.explode(pairs)).select(*customers.columns, "__t.*")


def active(experiment: Experiment, at: Column) -> Column:
    """Enabled and inside its dates; an open end never ends."""
    cond = F.lit(experiment.enabled)
    if experiment.start:
        cond = cond & (at >= F.lit(experiment.start).cast("timestamp"))
    if experiment.end:
        cond = cond & (at <= F.lit(experiment.end).cast("timestamp"))
    return cond


def record_treatment(df: DataFrame, experiment: Experiment) -> DataFrame:
    """Write the assignment into candidates created while the experiment runs."""
    treatment = F.struct(F.lit(experiment.id).alias("experiment_id"), assign_treatment(F.col("customer_id"), experiment).alias("treatment_id")).cast(ddl(TREATMENT))
    on = active(experiment, F.col("metadata.created_at"))
    value = F.when(on, treatment).otherwise(F.col("metadata.experiment_treatment"))
    return df.withColumn("metadata", F.col("metadata").withField("experiment_treatment", value))
