"""Document collections as tables, and the query shapes their users know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 5_000
MAX_ROWS = 1_000
READ_STAGES = ("match", "project", "sort", "limit", "skip", "group")


def document_keys(df: DataFrame, column: str) -> list[str]:
    """Top-level keys over all documents, in order of name. A key list is a schema, so its size is checked."""
    found = df.select(F.explode(F.json_object_keys(F.col(column))).alias("k")).distinct().orderBy("k").limit(MAX_KEYS + 1).collect()
    if len(found) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} distinct keys in {column}; this is not a table")
    return [r["k"] for r in found]


def flatten_documents(df: DataFrame, column: str, keys: Sequence[str] | None = None) -> DataFrame:
    """One column per top-level key; nested objects and lists stay as JSON text."""
    keys = list(keys or document_keys(df, column))
    doc = F.from_json(column, "map<string,string>")
    kept = [c for c in df.columns if c != column and c not in keys]
    return df.select(*kept, doc.alias("_d")).select(*kept, *[F.col("_d").getItem(k).alias(k) for k in keys])


def value_kind(c: Column) -> Column:
    """Type name of a JSON value's text."""
    text = F.trim(c)
    return (F.when(text.isNull() | (text == "null"), "null").when(text.startswith("{"), "object").when(text.startswith("["), "array")
            .when(text.isin("true", "false"), "bool").when(text.rlike(r"^-?\d+$"), "int")
            .when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "double").otherwise("string"))


def key_kinds(df: DataFrame, column: str) -> DataFrame:
    """(key, kind, n): types found per key."""
    cells = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return cells.groupBy("key", value_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def run_spec(df: DataFrame, spec: dict, most: int | None = MAX_ROWS) -> DataFrame:
    """``filter`` (SQL text), ``projection``, ``sort`` [(column, ±1)], ``limit``, or a ``stages`` list of those; never writes.

    ``most`` caps the rows of the final result only, as the callers of a document store expect; None returns all of them.
    """
    stages = spec.get("stages") or [{k: spec[k]} for k in ("filter", "projection", "sort", "limit") if spec.get(k) is not None]
    names = {"filter": "match", "projection": "project"}
    out = df
    for stage in stages:
        (kind, body), = stage.items()
        kind = names.get(kind, kind)
        if kind not in READ_STAGES:
            raise ValueError(f"stage {kind!r} is not a read")
        if kind == "match":
            out = out.where(body)
        elif kind == "project":
            out = out.select(*body)
        elif kind == "sort":
            out = out.orderBy(*[F.col(c).asc() if d > 0 else F.col(c).desc() for c, d in body])
        elif kind == "skip":
            out = out.offset(body)
        elif kind == "group":
            out = out.groupBy(*body["by"]).agg(*[F.expr(e).alias(n) for n, e in body["values"].items()])
        else:
            out = out.limit(body)
    return out if most is None else out.limit(most)
