"""Queries for R1-R8 over whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions import redact as rd
from beckon.plans.fixtures import fixture
from beckon.plans.registry import query

# the same rules written for the oracle's regex engine, which has no lookbehind
PHONE_RE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
CARD_RE = r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?(\d{4})\b"
SSN_RE = r"\b\d{3}-\d{2}-\d{4}\b"


def email_sql(text: str) -> str:
    """Split at each address, mask it, and join again."""
    pattern = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
    return f"""(with hits as (select regexp_extract_all({text}, '{pattern}') as h, string_split_regex({text}, '{pattern}') as p)
      select array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || case when i > len(h) then '' else
        (case when length(split_part(h[i], '@', 1)) > 1 then left(h[i], 1) || '***' else '***' end) || '@' ||
        (case when length(split_part(h[i], '@', 2)) > 4 then left(split_part(h[i], '@', 2), 1) || '***' || regexp_extract(h[i], '\\.[a-zA-Z0-9-]+$') else '***' end) end), '') from hits)"""


def rx(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def all_sql(text: str) -> str:
    return rx(rx(rx(email_sql(text), PHONE_RE, "***-***-****"), CARD_RE, r"****-****-****-\1"), SSN_RE, "***-**-****")


@query("r1_redact_email", f"select doc_id, md5({email_sql('text')}) as digest from documents")
def r1(spark, sf):
    return fixture(spark, sf, "documents").select("doc_id", F.md5(rd.redact_email(F.col("text"))).alias("digest"))


@query("r2_redact_phone", f"select doc_id, md5({rx('text', PHONE_RE, '***-***-****')}) as digest from documents")
def r2(spark, sf):
    return fixture(spark, sf, "documents").select("doc_id", F.md5(rd.redact_phone(F.col("text"))).alias("digest"))


_CARDS = "(select doc_id, text || ' card 4111-1111-1111-' || lpad(cast(doc_id % 10000 as string), 4, '0') as text from documents)"


@query("r3_redact_card", f"select doc_id, md5({rx('text', CARD_RE, '****-****-****-' + chr(92) + '1')}) as digest from {_CARDS}")
def r3(spark, sf):
    text = F.concat("text", F.lit(" card 4111-1111-1111-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    return fixture(spark, sf, "documents").select("doc_id", F.md5(rd.redact_card(text)).alias("digest"))


@query("r4_redact_ssn", f"select doc_id, md5({rx('text', SSN_RE, '***-**-****')}) as digest from documents")
def r4(spark, sf):
    return fixture(spark, sf, "documents").select("doc_id", F.md5(rd.redact_ssn(F.col("text"))).alias("digest"))


@query(
    "r5_redact_customer_id",
    """select c_custkey, case when length(c) = 0 then c when length(c) <= 4 then '****' else left(c, 4) || '******' end as masked,
    case when length(c) <= 8 then '****' else left(c, 4) || '****' || right(c, 4) end as context_masked
    from (select c_custkey, case c_custkey % 4 when 0 then '' when 1 then 'C' || (c_custkey % 100) when 2 then 'CUST' || (c_custkey % 1000) else c_name end as c from customer)""",
)
def r5(spark, sf):
    df = fixture(spark, sf, "customer").selectExpr(
        "c_custkey", "case c_custkey % 4 when 0 then '' when 1 then concat('C', c_custkey % 100) when 2 then concat('CUST', c_custkey % 1000) else c_name end as c"
    )
    return df.select("c_custkey", rd.redact_customer_id(F.col("c")).alias("masked"), rd.redact_customer_id_context(F.col("c")).alias("context_masked"))


@query(
    "r6_redact_address_name",
    """select p_partkey, case when p_partkey % 6 = 0 then '' else '[ADDRESS_REDACTED]' end as address,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1) || '***'), ' ') as masked_name from part""",
)
def r6(spark, sf):
    address = F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return fixture(spark, sf, "part").select("p_partkey", rd.redact_address(address).alias("address"), rd.redact_name(F.col("p_name")).alias("masked_name"))


@query("r7_redact_all", f"select doc_id, md5({all_sql('text')}) as digest from documents")
def r7(spark, sf):
    return fixture(spark, sf, "documents").select("doc_id", F.md5(rd.redact_all(F.col("text"))).alias("digest"))


@query("r7_redact_pages", f"select page_id, md5({all_sql('html')}) as digest from pages")
def r7_pages(spark, sf):
    return fixture(spark, sf, "pages").select("page_id", F.md5(rd.redact_all(F.col("html"))).alias("digest"))


@query(
    "r8_redact_columns",
    f"""select conv_id, turn, case when length('CONV-' || conv_id) <= 4 then '****' else 'CONV******' end as customer_id, '[REDACTED]' as card_no,
    case role when 'user' then 'u***' else upper(left(role, 0)) || left(role, 1) || '***' end as display_name, role as username, md5({all_sql('text')}) as digest from conversations""",
)
def r8(spark, sf):
    df = fixture(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat('CONV-', conv_id) as customer_id", "conv_id as card_no", "role as display_name", "role as username", "text as body"
    )
    out = rd.redact_columns(df)
    return out.select("conv_id", "turn", "customer_id", "card_no", "display_name", "username", F.md5("body").alias("digest"))
