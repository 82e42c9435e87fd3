"""URL filters: host rules first, then the likelihood ratio of two character models of accepted and rejected URLs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: The rules as the contract states them, (rule, verdict); a rule is a host and the beginning of a path.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Longest context, and the cells of the score's distribution on the URLs kept back for calibration.
ORDER = 4
CELL, CELLS = 1 / 64, 1024
#: Longest piece of a URL that is scored as one, steps of a ratio, and the number of grams that may be broadcast.
PIECE, STEPS, FREQUENT = 256, 1 << 40, 10_000
_EDGE = "\x02"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits as (rule, verdict), or null: its host is the host or a parent of it, its path begins the path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _pieces(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``keys``, piece): each URL's text in pieces that end with a slash or after ``PIECE`` characters.

    The text is what the URL has after ``://``, between two edge marks. Characters outside ASCII count as one symbol, so there are
    at most 130 symbols. A piece has before it the up to ``ORDER`` characters that precede it, and before those their number: all that
    decides its score.
    """
    text = F.concat(F.lit(_EDGE), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", ""), r"[^\x00-\x7f]", "ÿ"), F.lit(_EDGE))
    cut = f"(?s)(?<=(.{{{ORDER}}}|^.{{0,{ORDER - 1}}}))([^/]{{0,{PIECE - 1}}}/|[^/]{{1,{PIECE}}})"
    parts = rows.withColumn("_t", text).select(*keys, F.explode(F.arrays_zip(
        F.regexp_extract_all("_t", F.lit(cut), F.lit(1)).alias("before"), F.regexp_extract_all("_t", F.lit(cut), F.lit(2)).alias("own"))).alias("_p"))
    return parts.select(*keys, F.concat(F.char_length("_p.before").cast("string"), "_p.before", "_p.own").alias("piece"))


def _grams(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``keys``, gram) per symbol of a piece: the symbol with the up to ``ORDER`` before it. The first edge mark is not predicted."""
    first = F.greatest(F.substring("piece", 1, 1).cast("int") + 2, F.lit(3))
    low = lambda end: F.greatest(F.lit(2), end - ORDER)  # noqa: E731  the first character is the number
    places = F.when(F.char_length("piece") >= first, F.sequence(first, F.char_length("piece"))).otherwise(F.array().cast("array<int>"))
    return pieces.select(*keys, F.explode(F.transform(places, lambda end: F.col("piece").substr(low(end), end - low(end) + 1))).alias("gram"))


def _orders(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` with order, context and symbol, per gram and length of its context."""
    deep = grams.withColumn("order", F.explode(F.sequence(F.lit(0), F.char_length("gram") - 1)))
    context = F.col("gram").substr(F.char_length("gram") - F.col("order"), F.col("order"))
    return deep.select(*keys, "order", context.alias("context"), F.substring("gram", -1, 1).alias("symbol"))


def symbol_counts(labelled: DataFrame) -> DataFrame:
    """(context, symbol, good, bad, trial_good, trial_bad): the counts of both classes, and those without the URLs kept back.

    Equal pieces are counted before they are taken apart, and equal grams before their shorter contexts are.
    """
    good, trial = F.col("accepted").cast("int"), (~F.col("kept_back")).cast("int")
    first = {"good": good, "bad": 1 - good, "trial_good": good * trial, "trial_bad": (1 - good) * trial}
    sums = [F.sum(name).alias(name) for name in first]
    pieces = _pieces(labelled, ["accepted", "kept_back"]).groupBy("piece").agg(*[F.sum(c).alias(name) for name, c in first.items()])
    grams = _grams(pieces, list(first)).groupBy("gram").agg(*sums)
    return written(_orders(grams, list(first)).groupBy("context", "symbol").agg(*sums), "symbols")


def context_counts(pairs: DataFrame) -> DataFrame:
    """(context, good_n, good_kinds, bad_n, bad_kinds, next): per context the counts of both classes and of every symbol after it."""
    per = pairs.where("good + bad > 0").groupBy("context").agg(
        F.sum("good").alias("good_n"), F.sum((F.col("good") > 0).cast("int")).alias("good_kinds"), F.sum("bad").alias("bad_n"),
        F.sum((F.col("bad") > 0).cast("int")).alias("bad_kinds"), F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("good", "bad")))).alias("next"))
    return written(per, "contexts")


def gram_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, n, ratio) of distinct grams: ln P(symbol | accepted) - ln P(symbol | rejected), in whole steps of 1 / ``STEPS``.

    P is smoothed from the empty context upwards (Witten-Bell): each context that its class knows mixes its own counts with the shorter
    context's P, by the number of different symbols seen after it; contexts it does not know leave P as it is.
    """
    symbols = _orders(grams, ["gram", "n"])
    # At most 1 + 130 contexts of at most 130 symbols each: most grams have these, so they are not shuffled for.
    short, deep = F.col("order") < 2, F.col("order") >= 2
    near = symbols.where(short).join(F.broadcast(counts.where(F.char_length("context") < 2)), "context", "left")
    far = symbols.where(deep).join(counts.where(F.char_length("context") >= 2), "context")
    seen = near.unionByName(far)
    after = F.coalesce(F.col("next")[F.col("symbol")], F.struct(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
    step = F.struct("order", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("good_n", "good_kinds", "bad_n", "bad_kinds")], after["good"].cast("double").alias("good"), after["bad"].cast("double").alias("bad"))
    by_gram = seen.groupBy("gram").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.first("n").alias("n"))

    def chance(side: str) -> Column:
        return F.aggregate("steps", F.lit(1.0 / 131), lambda p, s: F.when(
            s[f"{side}_n"] > 0, (s[side] + s[f"{side}_kinds"] * p) / (s[f"{side}_n"] + s[f"{side}_kinds"])).otherwise(p))

    return by_gram.select("gram", "n", F.round((F.ln(chance("good")) - F.ln(chance("bad"))) * STEPS).cast("long").alias("ratio"))


def scores(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(``key``, score) of rows with distinct keys: the mean of the ratios of a URL's symbols.

    Every distinct piece is scored once, from the ratios of distinct grams. The grams that make up at least one part in ``FREQUENT``
    of all, so at most that many, are looked up by a broadcast join, which keeps them from gathering in one task; the others by a shuffled one. Ratios
    are whole numbers, so sums do not depend on their order.
    """
    numbered = written(rows.select(F.col(key).alias("_key"), "url").withColumn("_id", F.monotonically_increasing_id()), "texts")
    parts = written(_pieces(numbered, ["_id"]), "pieces")
    distinct = written(parts.groupBy("piece").agg(F.lit(1).alias("_one")).select("piece", F.monotonically_increasing_id().alias("_piece")), "distinct-pieces")
    symbols = _grams(distinct, ["_piece"])
    ratios = written(gram_ratios(symbols.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), counts), "ratios")
    every = ratios.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= every
    first = symbols.join(F.broadcast(ratios.where(often).select("gram", "ratio")), "gram", "left")
    near = first.where("ratio IS NOT NULL").select("_piece", "ratio")
    far = first.where("ratio IS NULL").select("_piece", "gram").join(ratios.where(~often).select("gram", "ratio"), "gram").select("_piece", "ratio")
    sums = [F.sum("ratio").alias("_sum"), F.count(F.lit(1)).alias("_n")]
    scored = distinct.join(near.unionByName(far).groupBy("_piece").agg(*sums), "_piece").select("piece", "_sum", "_n")
    totals = parts.join(scored, "piece").groupBy("_id").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return numbered.join(totals, "_id").select(F.col("_key").alias(key), (F.col("_sum") / F.lit(float(STEPS)) / F.col("_n")).alias("score"))


class Cut(NamedTuple):
    """The score from which on a URL is accepted, and the shares of accepted and rejected URLs kept back that it judges right."""

    score: float
    accepted_right: float
    rejected_right: float


def calibrated_cut(scored: DataFrame) -> Cut:
    """The cut where the shares of both classes judged right add up to most.

    From a table of at most ``CELLS`` cells per class, over all URLs kept back. At 0, with shares of 0, if one class has none.
    """
    cell = F.greatest(F.lit(-CELLS // 2), F.least(F.lit(CELLS // 2), F.floor(F.col("score") / CELL)))
    rows = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad")).collect()
    goods, bads = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not goods or not bads:
        return Cut(0.0, 0.0, 0.0)
    best, good, bad = Cut(0.0, 0.0, -1.0), goods, 0
    for r in sorted(rows, key=lambda r: r.cell):
        here = Cut(r.cell * CELL, good / goods, bad / bads)
        if sum(here[1:]) > sum(best[1:]):
            best = here
        good, bad = good - r.good, bad + r.bad
    return best


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    The longest fitting rule decides. The URLs that rules decide train the two models. Every fifth of them by its checksum sets the
    cut for the others, scored by models without that fifth. A null URL, or one without ``://``, has an empty host and path and is scored as the text it is. Repeated rows are
    judged alike. Without URLs of both classes every score is 0, or tells one class from nothing, and the cut is 0.
    """
    url = F.col("url")
    slim = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = slim.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("_r.rule")).withColumn("_v", F.col("_r.verdict")).drop("_r")
    kept_back = F.crc32(F.col("url").cast("binary")) % 5 == 0
    known = ruled.where(F.col("_v").isNotNull()).select("url", (F.col("_v") == "allow").alias("accepted"), kept_back.alias("kept_back"))
    pairs = symbol_counts(known)
    trial_counts = context_counts(pairs.select("context", "symbol", F.col("trial_good").alias("good"), F.col("trial_bad").alias("bad")))
    counts = context_counts(pairs)
    # Every text is scored once, however many pages have it.
    trial = known.where("kept_back").groupBy("url").agg(F.first("accepted").alias("accepted"))
    scored_trial = scores(trial, trial_counts, "url").join(trial, "url")
    cut = calibrated_cut(scored_trial).score
    rest = ruled.where(F.col("_v").isNull()).select(F.coalesce("url", F.lit("")).alias("_text"))
    texts = rest.distinct().select(F.col("_text").alias("url"))
    judged = scores(texts, counts, "url").select(F.col("url").alias("_text"), "score")
    verdict = F.coalesce("_v", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
    # URLs that a rule decides need no score; a key of their own keeps them apart.
    keyed = ruled.withColumn("_text", F.when(F.col("_v").isNull(), F.coalesce("url", F.lit(""))).otherwise(F.concat(F.lit("\x02"), F.col("page_id").cast("string"))))
    return keyed.join(judged, "_text", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
