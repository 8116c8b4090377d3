"""The nested candidate row and the other fixed table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

CONTEXT_ENTRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())])

SUBJECT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

SCORE = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

ATTRIBUTES = T.StructType([
    T.StructField("event_date", T.TimestampType()),
    T.StructField("delivery_date", T.TimestampType()),
    T.StructField("timing_window", T.StringType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("media_eligible", T.BooleanType()),
    T.StructField("channel_eligibility", T.MapType(T.StringType(), T.BooleanType())),
    T.StructField("consumed", T.BooleanType()),
    T.StructField("consumed_at", T.TimestampType()),
    T.StructField("consumed_channel", T.StringType()),
])

TREATMENT = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("treatment_id", T.StringType()),
])

METADATA = T.StructType([
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("version", T.LongType()),
    T.StructField("source_connector_id", T.StringType()),
    T.StructField("workflow_execution_id", T.StringType()),
    T.StructField("experiment_treatment", TREATMENT),
])

REJECTION = T.StructType([
    T.StructField("filter_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

CANDIDATE = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("context", T.ArrayType(CONTEXT_ENTRY)),
    T.StructField("subject", SUBJECT),
    T.StructField("scores", T.MapType(T.StringType(), SCORE)),
    T.StructField("attributes", ATTRIBUTES),
    T.StructField("metadata", METADATA),
    T.StructField("rejection_history", T.ArrayType(REJECTION)),
])

CUSTOMER_EVENT = T.StructType([
    T.StructField("customerId", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("subjectType", T.StringType()),
    T.StructField("subjectId", T.StringType()),
    T.StructField("programId", T.StringType()),
    T.StructField("marketplace", T.StringType()),
    T.StructField("eventDate", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

OPT_OUT_EVENT = T.StructType([
    T.StructField("customerId", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("programId", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def ddl(struct: T.StructType | T.DataType) -> str:
    """Type text usable in ``cast`` and ``from_json``."""
    return struct.simpleString()
