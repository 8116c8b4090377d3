"""Row validation, rule sets, duplicate detection, config checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts, is_iso_date, messages
from beckon.operators.timeline import _null_safe, greedy_openings

# fixed values: field groups of a raw record and the bounds of a plausible epoch
REQUIRED = ("customerId", "subjectType", "subjectId", "eventDate")
DATE_FIELDS = ("eventDate", "deliveryDate", "createdAt", "updatedAt", "expiresAt")
STRING_FIELDS = ("customerId", "subjectType", "subjectId")
NUMERIC_FIELDS = ("orderValue", "ttlDays")
BOOLEAN_FIELDS = ("mediaEligible", "emailEligible", "smsEligible", "pushEligible")
MAX_FUTURE = "INTERVAL '3650' DAY"
# fixed values: message texts of the record checks, which consumers compare
MISSING_TEXT = "Required field '{0}' is missing"
NULL_TEXT = "Required field '{0}' is null"
BLANK_TEXT = "Required field '{0}' is blank"
DATE_TEXT = "Field '{0}' has invalid date format: "
TYPE_TEXT = "Field '{0}' must be {1}, got "
MAX_REQUEST_LIMIT = 100


ALL_FIELDS = tuple(dict.fromkeys((*REQUIRED, *DATE_FIELDS, *STRING_FIELDS, *NUMERIC_FIELDS, *BOOLEAN_FIELDS)))


class Record:
    """Kind and text of a raw record's fields, as prepared by ``parse_records``."""

    @staticmethod
    def kind(field: str) -> Column:
        """STRING, BOOLEAN, NUMBER, OBJECT, ARRAY; VOID for JSON null; SQL null when missing."""
        return F.col(f"__kind_{field}")

    @staticmethod
    def text(field: str) -> Column:
        return F.col(f"__text_{field}")


def parse_records(df: DataFrame, column: str, fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
    """Parse JSON text once and lay out each field's kind and text; unused ones are pruned."""
    docs = df.withColumn("__doc", F.try_parse_json(F.col(column)))
    raw = docs.select("*", *[F.try_variant_get("__doc", f"$.{f}", "variant").alias(f"__raw_{f}") for f in fields]).drop("__doc")
    shown = {f"__shape_{f}": F.schema_of_variant(F.col(f"__raw_{f}")) for f in fields}
    texts = {f"__text_{f}": F.try_variant_get(F.col(f"__raw_{f}"), "$", "string") for f in fields}
    out = raw.withColumns({**shown, **texts}).drop(*[f"__raw_{f}" for f in fields])

    def kind(f: str) -> Column:
        k = F.col(f"__shape_{f}")
        return (
            F.when(k.isin("STRING", "BOOLEAN", "VOID"), k)
            .when(k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), "NUMBER")
            .when(k.startswith("OBJECT"), "OBJECT")
            .when(k.startswith("ARRAY"), "ARRAY")
        )

    return out.withColumns({f"__kind_{f}": kind(f) for f in fields}).drop(*[f"__shape_{f}" for f in fields])


def required_errors() -> Column:
    """V1."""
    parts = []
    for f in REQUIRED:
        kind = Record.kind(f)
        parts += [
            (kind.isNull(), F.lit(MISSING_TEXT.format(f))),
            (kind == "VOID", F.lit(NULL_TEXT.format(f))),
            ((kind == "STRING") & (F.trim(Record.text(f)) == ""), F.lit(BLANK_TEXT.format(f))),
        ]
    return messages(*parts)


def date_errors(as_of) -> Column:
    """V2: ISO text (zone optional, date-only allowed) or plausible epoch millis."""
    latest = F.unix_millis(as_ts(as_of) + F.expr(MAX_FUTURE))
    parts = []
    for f in DATE_FIELDS:
        kind, text = Record.kind(f), Record.text(f)
        millis = text.try_cast("double")
        ok = F.when(kind == "STRING", is_iso_date(text)).when(kind == "NUMBER", (millis > 0) & (millis < latest)).otherwise(False)
        parts.append((kind.isNotNull() & (kind != "VOID") & ~ok, F.concat(F.lit(DATE_TEXT.format(f)), text)))
    return messages(*parts)


def type_errors() -> Column:
    """V3."""
    parts = []
    for fields, want, word in ((STRING_FIELDS, "STRING", "a string"), (NUMERIC_FIELDS, "NUMBER", "numeric"), (BOOLEAN_FIELDS, "BOOLEAN", "boolean")):
        for f in fields:
            kind = Record.kind(f)
            parts.append((~kind.isin(want, "VOID"), F.concat(F.lit(TYPE_TEXT.format(f, word)), F.initcap(kind))))
    return messages(*parts)


def schema_errors(schema: Mapping) -> Column:
    """V4: JSON-Schema subset (required; type, enum, minimum, maximum, pattern per property)."""
    names = {"string": ("STRING",), "number": ("NUMBER",), "integer": ("NUMBER",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
    parts = [(Record.kind(f).isNull(), F.lit(f"$: required property '{f}' not found")) for f in schema.get("required", ())]
    for f, rule in schema.get("properties", {}).items():
        kind, text = Record.kind(f), Record.text(f)
        number = text.try_cast("double")
        if "type" in rule:
            bad = ~kind.isin(*names[rule["type"]])
            if rule["type"] == "integer":
                bad = bad | ((kind == "NUMBER") & (number != F.floor(number)))
            parts.append((bad, F.concat(F.lit(f"$.{f}: "), F.lower(kind), F.lit(f" found, {rule['type']} expected"))))
        if "enum" in rule:
            parts.append((kind.isNotNull() & ~F.coalesce(text.isin(*[str(v) for v in rule["enum"]]), F.lit(False)), F.lit(f"$.{f}: does not have a value in the enumeration")))
        if "minimum" in rule:
            parts.append(((kind == "NUMBER") & (number < rule["minimum"]), F.lit(f"$.{f}: must have a minimum value of {rule['minimum']}")))
        if "maximum" in rule:
            parts.append(((kind == "NUMBER") & (number > rule["maximum"]), F.lit(f"$.{f}: must have a maximum value of {rule['maximum']}")))
        if "pattern" in rule:
            parts.append(((kind == "STRING") & ~text.rlike(rule["pattern"]), F.lit(f"$.{f}: does not match the regex pattern {rule['pattern']}")))
    return messages(*parts) if parts else F.array().cast("array<string>")


def validate_rows(df: DataFrame, column: str, as_of, schema: Mapping | None = None) -> DataFrame:
    """V5: all record checks; ``valid`` when no message."""
    fields = dict.fromkeys((*ALL_FIELDS, *(schema or {}).get("required", ()), *(schema or {}).get("properties", {})))
    groups = ([schema_errors(schema)] if schema else []) + [required_errors(), date_errors(as_of), type_errors()]
    out = parse_records(df, column, list(fields)).withColumn("errors", F.concat(*groups))
    return out.withColumn("valid", F.size("errors") == 0).select(*df.columns, "errors", "valid")


def typed_rules(df: DataFrame, rules: Sequence[Mapping], as_of=None) -> DataFrame:
    """V6: messages for regex, number bound, date bound ("now+7d" style) and enum rules; nulls pass.

    A text that a bound needs as number or date and that is neither is reported, not compared.
    """

    def bound(text: str) -> Column:
        if not text.startswith("now"):
            return F.lit(text).cast("timestamp")
        days = int(text[3:].rstrip("d") or 0)
        return as_ts(as_of) + F.make_dt_interval(F.lit(days))

    parts = []
    kinds = dict(df.dtypes)
    for r in rules:
        col, name = F.col(r["field"]), r["field"]
        value = col
        if "pattern" in r:
            parts.append((~col.rlike(r["pattern"]), F.lit(f"{name}: pattern")))
        if r.get("type") == "date":
            lo, hi = (bound(r[k]) if k in r else None for k in ("min", "max"))
            if kinds.get(name) == "string":
                value = col.try_cast("timestamp")
        else:
            lo, hi = (F.lit(r[k]) if k in r else None for k in ("min", "max"))
            if kinds.get(name) == "string" and (lo is not None or hi is not None):
                value = col.try_cast("double")
        if value is not col:
            parts.append((col.isNotNull() & value.isNull(), F.lit(f"{name}: unreadable")))
        if lo is not None:
            parts.append((value < lo, F.lit(f"{name}: below min")))
        if hi is not None:
            parts.append((value > hi, F.lit(f"{name}: above max")))
        if "enum" in r:
            parts.append((~col.isin(*r["enum"]), F.lit(f"{name}: not allowed")))
    return df.withColumn("rule_errors", messages(*parts))


def business_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """V7: conditions that must hold; a failing one rejects or warns with its message."""
    fail = lambda r: ~F.coalesce(F.expr(r["condition"]), F.lit(False))
    for kind, name in (("reject", "rejects"), ("warn", "warnings")):
        chosen = [(fail(r), F.lit(r["message"])) for r in rules if r["onFailure"] == kind]
        df = df.withColumn(name, messages(*chosen) if chosen else F.array().cast("array<string>"))
    return df


def detect_duplicates(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window_s: int = 86400) -> DataFrame:
    """V8, T1 batch twin: ``is_duplicate`` for rows less than ``window_s`` after the last kept row.

    Null keys are equal to each other; a row without a time is no duplicate.
    Second precision; of rows in a keeping second the lowest ``tie`` is kept, of several rows with that tie (an event that
    was delivered again) one.
    """
    sec = F.unix_seconds(F.col(ts))
    opened = greedy_openings(df, keys, sec, window_s).filter("tick = opening").select(*keys, F.col("tick").alias("__sec"))
    first = df.groupBy(*keys, sec.alias("__sec")).agg(F.min(tie).alias("__first"))
    kept = _null_safe(first, opened, [*keys, "__sec"], "left_semi").withColumn("__kept", F.lit(True))
    # copies of one event are numbered, so that exactly one stays
    copy = F.row_number().over(Window.partitionBy(*keys, "__sec", tie).orderBy(tie))
    rows = _null_safe(df.withColumn("__sec", sec), kept, [*keys, "__sec"]).withColumn("__copy", copy)
    stays = F.coalesce(F.col("__kept"), F.lit(False)) & F.col(tie).eqNullSafe(F.col("__first")) & (F.col("__copy") == 1)
    return rows.withColumn("is_duplicate", F.col("__sec").isNotNull() & ~stays).drop("__sec", "__first", "__kept", "__copy")


def dead_letter_split(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """V9: (good rows, dead letters)."""
    return df.filter(F.size(errors) == 0).drop(errors), df.filter(F.size(errors) > 0)


def error_rate_gate(df: DataFrame, is_error: Column, max_rate: float = 0.05) -> DataFrame:
    """V9: one row: total, failed, rate and whether the batch must fail."""
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_error, 1)).alias("failed"))
    rate = F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(0.0)
    return agg.withColumn("error_rate", F.round(rate, 6)).withColumn("batch_failed", rate > max_rate)


def _blank(col: Column) -> Column:
    return F.coalesce(F.trim(col) == "", F.lit(True))


def program_config_errors() -> Column:
    """Messages over the nested program configuration columns."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    lists = {
        "dataConnectors": "data connector", "scoringModels": "scoring model", "filters": "filter", "channels": "channel", "marketplaces": "marketplace",
    }
    return messages(
        *[(_blank(F.col(c)), F.lit(f"{c}: blank")) for c in ("programId", "programName")],
        *[(empty(c), F.lit(f"{c}: names no {word}")) for c, word in lists.items()],
        (F.coalesce(F.col("candidateTTLDays") <= 0, F.lit(True)), F.lit("candidateTTLDays: not above zero")),
        (F.col("timingWindowDays") <= 0, F.lit("timingWindowDays: given but not above zero")),
        (F.trim("batchSchedule") == "", F.lit("batchSchedule: given but blank")),
    )


def connector_config_errors(expected_type: str, required: Sequence[str] = ("database", "query", "resultsBucket")) -> Column:
    """Messages over connectorId, connectorType, sourceConfig."""
    cfg = F.col("sourceConfig")
    return messages(
        (_blank(F.col("connectorId")), F.lit("connectorId: blank")),
        (_blank(F.col("connectorType")), F.lit("connectorType: blank")),
        (F.col("connectorType") != expected_type, F.concat(F.lit("connectorType: "), F.col("connectorType"), F.lit(f" is not {expected_type}"))),
        (F.coalesce(F.size(cfg), F.lit(0)) <= 0, F.lit(f"sourceConfig: empty for {expected_type}")),
        (cfg.isNull(), F.lit("sourceConfig: absent")),
        *[(cfg.isNotNull() & _blank(cfg[k]), F.lit(f"sourceConfig: {k} missing")) for k in required],
    )


def validate_features(features: DataFrame, entity: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per entity the missing features; only when none is missing, the invalid ones.

    ``features`` is long: entity, feature, type, num, str, bool.  A value is invalid when it
    does not fit its own type: NaN or infinite numbers, blank text, absent booleans.
    """
    num = F.col("num")
    bad = (
        F.when(F.col("type") == "NUMERIC", num.isNull() | F.isnan(num) | (F.abs(num) == F.lit(float("inf"))))
        .when(F.col("type") == "STRING", _blank(F.col("str")))
        .when(F.col("type") == "BOOLEAN", F.col("bool").isNull())
        .otherwise(F.col("type") != "LIST")
    )
    have = [F.max(F.when(F.col("feature") == n, F.coalesce(bad, F.lit(True)))).alias(f"__{i}") for i, n in enumerate(required)]
    wide = features.groupBy(*entity).agg(*have)
    flag = lambda i: F.col(f"__{i}")
    missing = messages(*[(flag(i).isNull(), F.lit(n)) for i, n in enumerate(required)])
    invalid = messages(*[(flag(i), F.lit(n)) for i, n in enumerate(required)])
    out = wide.select(*entity, missing.alias("missing"), invalid.alias("invalid"))
    none = F.array().cast("array<string>")
    out = out.withColumn("invalid", F.when(F.size("missing") == 0, F.col("invalid")).otherwise(none))
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("invalid") == 0))


def check_allocation(groups: DataFrame) -> DataFrame:
    """Allocations of an experiment must sum to exactly 100."""
    total = groups.groupBy("experiment_id").agg(F.sum("allocation").alias("total_allocation"))
    return total.withColumn("valid", F.col("total_allocation") == 100)


def candidate_violations() -> Column:
    """Broken invariants of a nested candidate."""
    meta, subject = F.col("metadata"), F.col("subject")
    outside = lambda c: (c < 0) | (c > 1)
    return messages(
        (_blank(F.col("customer_id")), F.lit("customer id blank")),
        (F.coalesce(F.size("context"), F.lit(0)) <= 0, F.lit("context empty")),
        (F.exists("context", lambda c: _blank(c["type"]) | _blank(c["id"])), F.lit("context entry blank")),
        (_blank(subject["type"]) | _blank(subject["id"]), F.lit("subject blank")),
        (F.coalesce(meta["version"] <= 0, F.lit(True)), F.lit("version not positive")),
        (_blank(meta["source_connector_id"]) | _blank(meta["workflow_execution_id"]), F.lit("provenance blank")),
        (F.exists(F.map_values("scores"), lambda s: outside(s["confidence"])), F.lit("confidence outside 0..1")),
    )


def serving_request_errors(batch_size: Column | None = None) -> Column:
    """V15."""
    parts = [
        (_blank(F.col("customer_id")), F.lit("customer id blank")),
        (_blank(F.col("marketplace")), F.lit("marketplace blank")),
        (F.col("max_results") < 1, F.lit("limit must be positive")),
        (F.col("max_results") > MAX_REQUEST_LIMIT, F.lit("limit too large")),
    ]
    if batch_size is not None:
        parts.append((batch_size > MAX_REQUEST_LIMIT, F.lit("batch too large")))
    return messages(*parts)
