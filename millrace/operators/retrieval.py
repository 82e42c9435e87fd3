"""Chunks of text, keyword payloads, vector search and dataset relevance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.windows import top_per_group
from millrace.session import kept, spread

# Chunk sizes and noise found in exported documentation pages.
MAX_CHUNK, MIN_CHUNK = 4000, 100
NOISE = "|".join((
    r"Back to top.*", r"© Copyright \d{4},.*", r"Previous\s*\n.*?\n.*?Next.*", r"\[Previous[^\]]*\]\([^)]*\)",
    r"\[Next[^\]]*\]\([^)]*\)", r"!\[\]\(https://static\.scarf\.sh[^)]*\)", r"Source code in `[^`]+`", r"-{3,}"))
NOISE_HEADINGS = ("back to top", "source code in", "previous", "next", "© copyright", "showing first")
MAX_QUERIES = 4096
MAX_NAME_LENGTHS = 256
#: Share of a query's postings that is probed for a score to beat, and how many of the datasets found there are scored in full.
PROBE_SHARE, LANES = 0.01, 8


def strip_noise(c: Column) -> Column:
    """Remove page furniture and squeeze blank lines."""
    bare = F.regexp_replace(F.regexp_replace(c, f"(?m){NOISE}", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def clean_heading(c: Column) -> Column:
    """Heading without its anchor, escaped underscores and hash marks."""
    bare = F.replace(F.regexp_replace(c, r"\[#\]\([^)]*\)", ""), F.lit("\\_"), F.lit("_"))
    return F.trim(F.regexp_replace(bare, "^#+", ""))


def is_noise_heading(c: Column) -> Column:
    low = F.lower(c)
    hit = F.lit(False)
    for words in NOISE_HEADINGS:
        hit = hit | low.contains(words)
    return hit


def packed_paragraphs(text: Column, heading: Column, max_chars: int) -> Column:
    """Greedy packing of blank-line paragraphs into parts of at most ``max_chars``; long texts only."""
    title = F.concat(F.lit("## "), heading, F.lit(" (continued)"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"),
                     F.lit(0).alias("size"))

    def add(state: Column, para: Column) -> Column:
        full = state["now"].isNotNull() & (state["size"] + F.length(para) > max_chars)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(title, F.lit("\n\n"), para)).when(state["now"].isNull(), para).otherwise(
                F.concat(state["now"], F.lit("\n\n"), para)).alias("now"),
            F.when(full, F.length(title) + F.length(para)).otherwise(state["size"] + F.length(para)).alias("size"))

    def close(state: Column) -> Column:
        return F.when(state["now"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["now"]))

    parts = F.aggregate(F.split(text, "\n\n"), start, add, close)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(parts)


def chunks(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHUNK, min_chars: int = MIN_CHUNK) -> DataFrame:
    """(key, section, part, heading, chunk_type, text): a document cut at its headings, long sections at blank lines.

    Three or more third-level headings cut there; else second-level ones; else any third-level one; else the whole
    text is one chunk. Everything happens inside the row, so there is no shuffle.
    """
    work = df.select(key, strip_noise(F.col(text)).alias("_t"))
    h2, h3 = F.split("_t", "(?m)^## "), F.split("_t", "(?m)^### ")
    work = work.withColumns({"_h2": h2, "_h3": h3})
    third = (F.size("_h3") >= 4) | ((F.size("_h2") < 2) & (F.size("_h3") >= 2))
    cut = F.when(third, F.col("_h3")).when(F.size("_h2") >= 2, F.col("_h2"))
    work = work.select(key, "_t", F.when(third, "### ").otherwise("## ").alias("_p"), cut.alias("_s"))

    def section(s: Column, i: Column) -> Column:
        lines = F.split(s, "\n", 2)
        raw = F.trim(F.get(lines, F.lit(0)))
        body = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
        whole = F.regexp_replace(F.concat(F.col("_p"), raw, F.lit("\n\n"), body), r"\s+$", "")
        return F.struct(i.alias("section"), clean_heading(raw).alias("heading"), whole.alias("text"))

    found = F.filter(F.transform("_s", section), lambda s: (s["section"] > 0) & ~is_noise_heading(s["heading"]) & (
        F.length(s["text"]) >= min_chars))
    work = work.withColumn("_f", F.coalesce(found, F.array().cast(
        "array<struct<section:int,heading:string,text:string>>")))
    first = F.regexp_extract("_t", r"(?m)^#{1,3} (.+)", 1)
    fallback = F.struct(F.lit(0).alias("section"), clean_heading(first).alias("heading"), F.col("_t").alias("text"))
    whole = (F.size("_f") == 0)
    sections = F.when(~whole, F.col("_f")).when(F.length(F.trim("_t")) >= min_chars, F.array(fallback))
    rows = work.select(key, whole.alias("_w"), F.explode(sections).alias("s"))
    parts = F.when(F.col("_w"), F.array("s.text")).otherwise(packed_paragraphs(F.col("s.text"), F.col("s.heading"), max_chars))
    rows = rows.select(key, "_w", "s.section", "s.heading", parts.alias("_parts"))
    rows = rows.select(key, "_w", "section", "heading", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("part", "text"))
    kind = F.when(F.col("_w"), "full_file").when(F.col("_n") == 1, "function").otherwise(
        F.concat(F.lit("function_part_"), (F.col("part") + 1).cast("string")))
    return rows.select(key, "section", "part", "heading", kind.alias("chunk_type"), "text")


def unique_chunks(df: DataFrame, text: str, rank: str) -> DataFrame:
    """Chunks with the same trimmed text once, the best ranked kept; a text repeated everywhere is combined map-side."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    rows = df.withColumn(text, clean).where(F.col(text) != "")
    rest = [c for c in df.columns if c != text]
    best = rows.groupBy(text).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(text, "_b.*")


def keywords(c: Column) -> Column:
    """Search terms of a request line: names called in its ``[Function: ...]`` block, then quoted text."""
    block = F.regexp_extract(c, r"\[Function:\s*(.*?)\]", 1)
    names = F.transform(F.regexp_extract_all(block, F.lit(r"([a-zA-Z_]+)\(\)"), F.lit(1)),
                        lambda f: F.concat(f, F.lit(" function")))
    quoted = F.regexp_extract_all(c, F.lit(r"(['\"].*?['\"])"), F.lit(1))
    return F.array_join(F.concat(names, quoted), " ")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def fit_dimension(c: Column, dim: int) -> Column:
    """Trim or pad with zeros to ``dim`` numbers."""
    padded = F.concat(c.cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
    return F.slice(padded, 1, dim)


def nearest(
    vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int
) -> DataFrame:
    """(query, key, position, similarity): the ``k`` most similar vectors of every query, exactly.

    Queries travel to the data in blocks of at most ``MAX_QUERIES``; every Arrow batch keeps its own best ``k`` per query
    before anything is shuffled, so a partition sends k rows per query however many vectors it holds. Scalar filters go
    on ``vectors`` before the call and reach the scan.
    """
    ordered = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).orderBy("q")
    out, offset = None, 0
    while True:
        block = ordered.offset(offset).limit(MAX_QUERIES).collect()
        if not block and out is not None:
            break
        one = _nearest_block(vectors, key, vector, [(r["q"], r["v"]) for r in block], ordered.schema["q"].dataType, k)
        out = one if out is None else out.unionByName(one)
        if len(block) < MAX_QUERIES:
            break
        offset += MAX_QUERIES
    return top_per_group(out, ["query"], [F.desc("similarity"), F.asc(key)], k).select("query", key, "position", "similarity")


def _nearest_block(vectors, key, vector, block, query_type, k) -> DataFrame:
    names = [q for q, _ in block]
    matrix = np.array([v for _, v in block], dtype=np.float64)
    sizes = np.linalg.norm(matrix, axis=1) if len(block) else np.zeros(0)
    matrix = matrix / np.where(sizes > 0, sizes, 1.0)[:, None] if len(block) else matrix
    key_type = vectors.schema[key].dataType

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch) or not names:
                continue
            rows = np.stack(batch["_v"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(rows, axis=1)
            scores = matrix @ (rows / np.where(length > 0, length, 1.0)[:, None]).T
            keep = min(k, scores.shape[1])
            # Everything that ties with the k-th best stays, so the tie-break by key is decided globally.
            floor = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            q, i = np.nonzero(scores >= floor[:, None])
            found = pd.DataFrame({"query": [names[x] for x in q], key: batch[key].to_numpy()[i], "similarity": scores[q, i]})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["similarity", key], ascending=[False, True]).groupby("query", sort=False).head(k)
        if best is not None:
            yield best

    schema = T.StructType([T.StructField("query", query_type), T.StructField(key, key_type),
                           T.StructField("similarity", T.DoubleType())])
    slim = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v"))
    return slim.mapInPandas(search, schema)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of two or more letters or digits."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def relevance(
    datasets: DataFrame, key: str, descriptor: str, alias: str, filename: str, queries: DataFrame, query_key: str, text: str
) -> DataFrame:
    """(query, best, score): the dataset that fits each query best, the smallest id of equals; ids are unique on both sides.

    Score: shared words, +5 when the alias is mentioned, +3 for the file name, +1 for the id. Datasets that share no word with a
    query can win by a bonus alone; those are the first of each mentioned (alias, file name) group, those whose id is
    mentioned, and the first dataset of all. The others come from ``candidates``, and only they are scored in full.
    """
    q = queries.select(F.col(query_key).alias("query"), F.lower(text).alias("_q"), tokens(F.col(text)).alias("_qt"))
    slim = spread(datasets.select(key, descriptor, alias, filename))
    d = kept(slim.select(F.col(key).alias("id"), tokens(F.col(descriptor)).alias("_dt"), F.lower(alias).alias("_a"), F.lower(filename).alias("_f")), "descriptors")
    heads = kept(_mentioned(d, q), "mentioned")
    scored = _in_full(kept(candidates(d, q, heads), "candidates"), d, q)
    best = F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))
    return scored.unionByName(heads.select("query", "id", "score")).groupBy("query").agg(best.alias("b")).select(
        "query", F.col("b.id").alias("best"), F.col("b.score").alias("score"))


def _found(name: Column) -> Column:
    return F.coalesce((F.length(name) > 0) & F.contains(F.col("_q"), name), F.lit(False)).cast("double")


def _name_bonus() -> Column:
    return 5.0 * _found(F.col("_a")) + 3.0 * _found(F.col("_f"))


def _id_bonus() -> Column:
    return _found(F.lower(F.col("id").cast("string")))


def _mentioned(d: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id, names, own, score): what a bonus alone gives, for the datasets that may win by it.

    A mention is a substring of the query, so the query's pieces of the lengths that names and ids have meet them by equality.
    """
    facts = d.select("id", "_a", "_f", F.lower(F.col("id").cast("string")).alias("_id"))
    sizes = facts.select(F.explode(F.array(F.length("_a"), F.length("_f"), F.length("_id"))).alias("n")).where("n > 0").distinct()
    lengths = [r["n"] for r in sizes.limit(MAX_NAME_LENGTHS + 1).collect()]
    if len(lengths) > MAX_NAME_LENGTHS:
        raise ValueError(f"names of more than {MAX_NAME_LENGTHS} different lengths; shorten the descriptors' alias and file name")
    groups = facts.groupBy("_a", "_f").agg(F.min("id").alias("id"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("_q"), F.lit(1))))
    pieces = q.select("query", "_q", at.alias("i"))
    pieces = pieces.select("query", "_q", F.explode(F.array(*[
        F.substr("_q", F.col("i"), F.lit(n)) for n in lengths])).alias("piece")).distinct() if lengths else q.select(
        "query", "_q", F.lit("").alias("piece"))
    columns = ("query", "_q", "id", "_a", "_f")
    found = [side.join(pieces, F.col(c) == F.col("piece")).select(*columns) for side, c in ((groups, "_a"), (groups, "_f"), (facts, "_id"))]
    first = facts.orderBy("id").limit(1).select(F.struct("id", "_a", "_f").alias("s")).scalar()
    fallback = q.select("query", "_q", first.alias("s")).select("query", "_q", "s.*").select(*columns)
    heads = reduce(DataFrame.unionByName, [*found, fallback]).select("query", "id", _name_bonus().alias("names"), _id_bonus().alias("own"))
    return heads.withColumn("score", F.when(F.col("id").isNotNull(), F.col("names") + F.col("own")))


def _in_full(pairs: DataFrame, d: DataFrame, q: DataFrame) -> DataFrame:
    """(query, id, score) of (query, id) pairs."""
    joined = pairs.select("query", "id").join(d, "id").join(q, "query")
    shared = F.size(F.array_intersect("_dt", "_qt")).cast("double")
    return joined.select("query", "id", (shared + _name_bonus() + _id_bonus()).alias("score"))


def candidates(d: DataFrame, q: DataFrame, heads: DataFrame) -> DataFrame:
    """(query, id, n): the pairs that share words and whose score may be the query's best; no other pair is formed but the probes.

    A query's words are sorted by how many datasets have them, rarest first. The datasets that share its rarest words (``PROBE_SHARE``
    of its postings) are probed: the best of each of ``LANES`` lanes is scored in full, and no winner scores less. A
    dataset without any of the first p of m words scores at most m - p and the largest bonus, so the words after the p
    where this falls below the best score so far need not be met: a frequent word joins nothing where a rare one decides. Where the best score
    is low, p is m, and all pairs that share a word are formed.
    """
    words = q.select("query", F.explode("_qt").alias("w"))
    postings = d.select("id", F.explode("_dt").alias("w"))
    often = postings.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    whole = Window.partitionBy("query")
    rarest = whole.orderBy("df", "w")
    upto = rarest.rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept(words.join(often, "w").select(
        "query", "w", F.row_number().over(rarest).alias("pos"), F.count(F.lit(1)).over(whole).alias("m"),
        (F.sum("df").over(upto) <= PROBE_SHARE * F.sum("df").over(whole)).alias("probe")), "ranked")

    probed = postings.join(ranked.where("pos = 1 OR probe").select("query", "w"), "w").groupBy("query", "id").agg(F.count(F.lit(1)).alias("n"))
    lane = F.pmod(F.xxhash64("id"), F.lit(LANES))
    tops = probed.groupBy("query", lane.alias("lane")).agg(F.max(F.struct("n", "id")).alias("top")).select("query", "top.id")
    # Written first, so that the planner knows how few they are and leaves the datasets' words where they lie.
    tops = kept(tops, "probed")
    floors = _in_full(tops, d, q).select("query", "score", F.lit(0.0).alias("names"), F.lit(0.0).alias("own"))
    floors = floors.unionByName(heads.select("query", "score", "names", "own"))
    bounds = floors.groupBy("query").agg(F.max("score").alias("least"), (F.max("names") + F.max("own")).alias("bonus"))

    met = F.least(F.col("m") + F.col("bonus") - F.col("least") + 1, F.col("m"))
    needed = (F.col("least") - F.col("bonus") - (F.col("m") - F.col("met"))).alias("needed")
    prefix = ranked.join(bounds, "query").withColumn("met", met).where("pos <= met").select("query", "w", needed)
    counted = postings.join(prefix, "w").groupBy("query", "id").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return counted.where("n >= needed").select("query", "id", "n")
