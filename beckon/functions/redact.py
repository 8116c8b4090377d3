"""Masking of personal data in text columns, all in JVM-side regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what counts as personal data and what replaces it
EMAIL_USER, EMAIL_DOMAIN = r"[a-zA-Z0-9._%+-]", r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
CARD = r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?(\d{4})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE_MASK, CARD_MASK, SSN_MASK = "***-***-****", "****-****-****-$1", "***-**-****"
ADDRESS_MASK = "[ADDRESS_REDACTED]"
OBJECT_MASK = "[REDACTED]"
CUSTOMER_MASK = "******"
SENSITIVE_WORDS = ("email", "phone", "address", "ssn", "creditcard", "card")

# A matched address is first fenced with two marks that do not occur in text, so the
# follow-up passes touch matches only and the match itself is never rescanned.
_OPEN, _AT, _CLOSE = "\x01", "\x02", "\x03"


def redact_email(col: Column) -> Column:
    """Keep the first letter of user and domain and the last domain part; short parts vanish."""
    fenced = F.regexp_replace(col, f"({EMAIL_USER}+)@({EMAIL_DOMAIN})", f"{_OPEN}$1{_AT}$2{_CLOSE}")
    user = F.regexp_replace(fenced, f"{_OPEN}(.){EMAIL_USER}+{_AT}", f"$1***@{_AT}")
    user = F.regexp_replace(user, f"{_OPEN}.{_AT}", f"***@{_AT}")
    domain = F.regexp_replace(user, f"{_AT}(.)[a-zA-Z0-9.-]*(\\.[a-zA-Z0-9-]+){_CLOSE}(?<=[^{_AT}]{{5}}{_CLOSE})", "$1***$2")
    return F.regexp_replace(domain, f"{_AT}[^{_CLOSE}]*{_CLOSE}", "***")


def redact_phone(col: Column) -> Column:
    """R2."""
    return F.regexp_replace(col, PHONE, PHONE_MASK)


def redact_card(col: Column) -> Column:
    """R3."""
    return F.regexp_replace(col, CARD, CARD_MASK)


def redact_ssn(col: Column) -> Column:
    """R4."""
    return F.regexp_replace(col, SSN, SSN_MASK)


def redact_customer_id(col: Column) -> Column:
    """First four characters survive, ids of up to four characters vanish."""
    return F.when(F.length(col) == 0, col).when(F.length(col) <= 4, F.lit("****")).otherwise(F.concat(F.substring(col, 1, 4), F.lit(CUSTOMER_MASK)))


def redact_customer_id_context(col: Column) -> Column:
    """R5, logging-context variant: first and last four characters survive beyond eight."""
    masked = F.concat(F.substring(col, 1, 4), F.lit("****"), F.right(col, F.lit(4)))
    return F.when(F.length(col) <= 8, F.lit("****")).otherwise(masked)


def redact_address(col: Column) -> Column:
    """R6."""
    return F.when(F.length(col) > 0, F.lit(ADDRESS_MASK)).otherwise(col)


def redact_name(col: Column) -> Column:
    """Every word becomes its initial and a mask; runs of blanks collapse."""
    words = F.split(F.regexp_replace(col, r"\s+$", ""), r"\s+")
    masked = F.transform(words, lambda w: F.when(F.length(w) > 0, F.concat(F.substring(w, 1, 1), F.lit("***"))).otherwise(F.lit("")))
    return F.when(F.length(col) == 0, col).otherwise(F.array_join(masked, " "))


def redact_all(col: Column) -> Column:
    """Email, phone, card, ssn in this order (so the phone rule reaches long digit runs first).

    Every rule needs an at sign or four digits in a row, so most text is looked at once and left alone.
    """
    mail = F.when(F.instr(col, "@") > 0, redact_email(col)).otherwise(col)
    return F.when(col.rlike("[0-9]{4}"), redact_ssn(redact_card(redact_phone(mail)))).otherwise(mail)


def redact_columns(df: DataFrame) -> DataFrame:
    """Choose the rule by column name; every other text column is scanned."""
    out = []
    for field in df.schema.fields:
        name, col = field.name.lower(), F.col(f"`{field.name}`")
        text = isinstance(field.dataType, T.StringType)
        if any(w in name for w in SENSITIVE_WORDS):
            col = redact_all(col) if text else F.when(col.isNotNull(), F.lit(OBJECT_MASK))
        elif not text:
            pass
        elif "customerid" in name or "customer_id" in name:
            col = redact_customer_id(col)
        elif "name" in name and "filename" not in name and "username" not in name:
            col = redact_name(col)
        else:
            col = redact_all(col)
        out.append(col.alias(field.name))
    return df.select(out)
