"""Find personal data in columns and take it out again."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions.missing import parse_day
from millrace.functions.privacy import export_actor, luhn_valid, pseudonym, tail_token
from millrace.operators.profile import kind_of
from millrace.session import spread

# Match threshold, value patterns, name hints (first match wins), what kind of identifier each is.
MATCH_SHARE = 0.8
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[\d][\d\s().-]{6,18}\d$"
PLAIN_NUMBER = r"^[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
POSTCODE = r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$|^\d{5}(-\d{4})?$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"
NAME_HINTS = (
    (r"e[-_]?mail", "email"),
    (r"phone|mobile|msisdn|telephone", "phone"),
    (r"(?:^|[^a-z])ssn(?:$|[^a-z])|social_?security|national_?id|aadhaar|nino", "national_id"),
    (r"credit_?card|card_?number|\bpan\b|ccnum", "credit_card"),
    (r"ip_?addr|client_?ip", "ip_address"),
    (r"first_?name|last_?name|surname|full_?name|customer_?name|\bname\b", "person_name"),
    (r"birth|\bdob\b", "date_of_birth"),
    (r"post_?code|zip_?code|postal", "postcode"),
    (r"address|street|addr_?line", "address"),
    (r"gender|\bsex\b", "gender"),
    (r"account_?(id|number)|customer_?id|user_?id|member_?id", "account_id"),
)
DIRECT = ("email", "phone", "national_id", "credit_card", "account_id")
QUASI = ("person_name", "date_of_birth", "postcode", "address", "gender", "ip_address")
STRATEGY = {
    "credit_card": "tokenise", "date_of_birth": "generalise", "postcode": "generalise", "person_name": "pseudonymise",
    "address": "keep", "gender": "keep", "ip_address": "keep",
}
REDACTED = "__redacted__"


def scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, sensitivity, confidence, strategy) for every column that looks personal.

    Value evidence outranks name hints; numeric columns skip the value patterns. All rows are measured, in one pass.
    """
    columns = list(columns or df.columns)
    df = spread(df.select(*columns))
    cells = []
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        usable = F.when((text != "") & F.lit(kind_of(df.schema[c]) != "numeric"), text)
        phone = usable.rlike(PHONE) & ~usable.rlike(DATE) & ~usable.rlike(PLAIN_NUMBER)

        def share(p: Column) -> Column:
            return F.coalesce(F.avg(p.cast("double")), F.lit(0.0))

        cells.append(F.struct(
            F.lit(c).alias("column"), share(usable.rlike(EMAIL)).alias("email"), share(usable.rlike(IPV4)).alias("ip_address"),
            share(luhn_valid(usable)).alias("credit_card"), share(phone).alias("phone"),
            share(usable.rlike(DATE)).alias("dates"), share(usable.rlike(POSTCODE)).alias("postcodes"),
            F.approx_count_distinct(F.lower(usable)).alias("levels")))
    rows = df.agg(F.array(*cells).alias("r")).select(F.inline("r"))
    by_value = F.lit(None).cast("string")
    rate = F.lit(None).cast("double")
    for k in reversed(("email", "ip_address", "credit_card", "phone")):
        hit = F.col(k) >= MATCH_SHARE
        by_value, rate = F.when(hit, k).otherwise(by_value), F.when(hit, F.col(k)).otherwise(rate)
    hints = {c: next((k for p, k in NAME_HINTS if re.search(p, c, re.I)), None) for c in columns}
    hinted = F.lit(None).cast("string")
    for c, k in hints.items():
        if k:
            hinted = F.when(F.col("column") == c, k).otherwise(hinted)
    agreed = (
        F.when((hinted == "date_of_birth") & (F.col("dates") >= MATCH_SHARE), 0.95)
        .when((hinted == "postcode") & (F.col("postcodes") >= MATCH_SHARE), 0.95)
        .when((hinted == "gender") & (F.col("levels") <= 4), 0.85).otherwise(0.6))
    found = rows.select("column", F.coalesce(by_value, hinted).alias("kind"), F.coalesce(rate, agreed).alias("confidence"))
    strategy = F.lit("pseudonymise")
    for k, s in STRATEGY.items():
        strategy = F.when(F.col("kind") == k, s).otherwise(strategy)
    return found.where("kind is not null").select(
        "column", "kind", F.when(F.col("kind").isin(*DIRECT), "direct").otherwise("quasi").alias("sensitivity"),
        F.round("confidence", 3).alias("confidence"), strategy.alias("strategy"))


def residual_risk(findings: DataFrame) -> DataFrame:
    """One row when two or more quasi-identifiers remain: their number and names."""
    quasi = findings.where("sensitivity = 'quasi'")
    return quasi.agg(F.count("*").alias("n_quasi"),
                     F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns")).where("n_quasi >= 2")


def contract(findings: DataFrame) -> dict[str, dict[str, str]]:
    """Column → kind and strategy; holds no key and no value, so it can be stored next to a model."""
    return {r["column"]: {"kind": r["kind"], "strategy": r["strategy"]}
            for r in findings.collect() if r["strategy"] != "keep"}


def transformed(c: Column, column: str, kind: str, strategy: str, key: bytes | None, reference_year: int) -> Column:
    if strategy == "redact":
        # Nulls too: which rows held a value is itself information.
        return F.lit(REDACTED)
    if strategy == "keep":
        return c
    if strategy == "generalise" and kind == "date_of_birth":
        return D.age_band(parse_day(c.cast("string")), reference_year)
    if strategy == "generalise" and kind == "postcode":
        return D.postcode_area(c)
    if not key:
        raise ValueError(f"{column!r} needs a key for {strategy}")
    if strategy == "tokenise":
        return tail_token(c, key, column)
    return pseudonym(c, key, column)


def deidentify(
    df: DataFrame, rules: dict[str, dict[str, str]], key: bytes | None = None, reference_year: int = 2026,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """Apply a contract: one projection, whatever the number of columns."""
    changes = {}
    for c, rule in rules.items():
        if c in df.columns:
            strategy = (overrides or {}).get(c, rule["strategy"])
            changes[c] = transformed(F.col(c), c, rule["kind"], strategy, key, reference_year)
    return df.withColumns(changes) if changes else df


def export_rows(
    events: DataFrame, allowed: dict[str, Column], install: str, actor: str, received_at: str, secret: bytes
) -> DataFrame:
    """Allow-listed projection: a declared column leaves only where its check holds; the actor is re-keyed per epoch."""
    cells = [F.when(F.coalesce(valid, F.lit(False)), F.col(name)).alias(name) for name, valid in allowed.items()]
    return events.select(
        *cells, F.lit(install).alias("install_id"),
        export_actor(F.col(actor), F.col(received_at), secret).alias("actor_id"))
