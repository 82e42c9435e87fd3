"""Consistent weighted sampling: signatures that agree with the probability of the generalised Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BLANK, shuffle_parts, written

SAMPLES = 32
#: Samples per row of the sampling step: few enough that one row's work is compiled as a whole.
LANES = 4
#: ln a lies within (-128, 128) for any count of words a text can hold; it is kept in steps of 2**-23.
_SHIFT, _STEPS = 128, 1 << 23
_LOW = (1 << 32) - 1
#: Stands for a null doc_id in the order.
_NO_ID = -(1 << 63)


def _draws(term: Column, j: Column) -> dict[str, Column]:
    """What sample ``j`` draws from a term, given as its 64-bit hash: r and c, Gamma(2, 1), b, uniform, and a hash of both."""
    one, two = F.xxhash64(term.bitwiseXOR(2 * j)), F.xxhash64(term.bitwiseXOR(2 * j + 1))

    def uniform(bits: Column, width: int) -> Column:
        return (bits.cast("double") + 0.5) / float(1 << width)

    r = -F.ln(uniform(F.shiftrightunsigned(one, 32), 32) * uniform(one.bitwiseAND(F.lit(_LOW)), 32))
    c = -F.ln(uniform(F.shiftrightunsigned(two, 43), 21) * uniform(F.shiftrightunsigned(two, 22).bitwiseAND(F.lit((1 << 21) - 1)), 21))
    return {"one": one, "r": r, "ln_c": F.ln(c), "b": uniform(two.bitwiseAND(F.lit((1 << 22) - 1)), 22)}


def _packed(draws: dict[str, Column], log_weight: Column) -> Column:
    """A weighted term's sample: the value to minimise in the high half, the sample's identity in the low one.

    t = floor(ln w / r + b), y = exp(r (t - b)), and the term with the least a = c / (y exp(r)) is drawn, with t. The
    identity is of (term, j, t).
    """
    r, b = draws["r"], draws["b"]
    t = F.floor(log_weight / r + b)
    value = F.floor((draws["ln_c"] - r * (t - b + 1) + _SHIFT) * _STEPS)
    return F.shiftleft(value, 32) + draws["one"].bitwiseXOR(t).bitwiseAND(F.lit(_LOW))


def signed(counted: DataFrame, by: list[str], sides: tuple[str, str], samples: int = SAMPLES, notes: int = 0) -> DataFrame:
    """(``by``, one column per side, _notes): the signatures of each group of (``by``, term, weights, _tag) rows, eight hex digits per sample.

    ``sides`` names the two weights of a term, 0 where it is not in that text; both samples share their draws, and equal
    weights the sample. Each row is repeated once per ``LANES`` samples. A side without terms has zeros. Rows of tag 1 to ``notes`` are no
    terms but numbers of their group, one of each tag, which come out in ``_notes`` by tag: a group's own columns then need
    not be keys of every step. Tag 0 are the terms.
    """
    blocks, lanes = samples // LANES, range(LANES)
    own, other = sides
    tagged = F.col("_tag") > 0
    numbers = F.when(tagged, F.array(F.lit(blocks - 1) + F.col("_tag"))).otherwise(F.sequence(F.lit(0), F.lit(blocks - 1)))
    logs = {f"_log_{side}": F.when(F.col(side) > 0, F.ln(F.col(side).cast("double"))) for side in sides}
    repeated = counted.withColumns(logs).withColumn("_b", F.explode(numbers))
    draws = [_draws(F.col("term"), F.col("_b") * LANES + i) for i in lanes]
    drawn = repeated.select("*", *[x.alias(f"_{name}{i}") for i in lanes for name, x in draws[i].items()])
    named = [{name: F.col(f"_{name}{i}") for name in draws[i]} for i in lanes]
    first = [F.when(tagged, F.col("term")).when(F.col(own) > 0, _packed(named[i], F.col(f"_log_{own}"))) for i in lanes]
    firsts = drawn.withColumns({f"_s{i}": first[i] for i in lanes})
    second = [F.when(F.col(own) == F.col(other), F.col(f"_s{i}")).when(F.col(other) > 0, _packed(named[i], F.col(f"_log_{other}"))) for i in lanes]
    samples_of = firsts.select(*by, "_b", *[F.col(f"_s{i}").alias(f"{own}{i}") for i in lanes], *[second[i].alias(f"{other}{i}") for i in lanes])
    least = samples_of.groupBy(*by, "_b").agg(*[F.min(f"{side}{i}").alias(f"{side}{i}") for side in sides for i in lanes])

    def digits(side: str) -> Column:
        low = [F.coalesce(F.col(f"{side}{i}").bitwiseAND(F.lit(_LOW)), F.lit(0)) for i in lanes]
        return F.concat(*[F.lpad(F.lower(F.hex(x)), 8, "0") for x in low])

    parts = least.select(*by, F.struct("_b", F.col(f"{own}0").alias("_note"), *[digits(side).alias(side) for side in sides]).alias("_p"))
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    drawn_parts = F.filter("_ps", lambda p: p["_b"] < blocks)
    noted = F.filter("_ps", lambda p: p["_b"] >= blocks)
    return rows.select(
        *by, *[F.rpad(F.concat_ws("", drawn_parts[side]), 8 * samples, "0").alias(side) for side in sides], noted["_note"].alias("_notes"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; two texts without terms are alike."""
    places = F.sequence(F.lit(0), F.lit(samples - 1))
    equal = F.filter(places, lambda j: F.substring(a, 8 * j + 1, F.lit(8)) == F.substring(b, 8 * j + 1, F.lit(8)))
    return F.size(equal).cast("double") / float(samples)


def _following(keys: DataFrame) -> DataFrame:
    """(doc_id, next_id) over different ids, ascending, the first after the last.

    Range partitions of the ids are written; each row's follower is found inside its partition, and a partition's last row
    takes the first of the next partition that has rows, from a table of one row per partition.
    """
    ranged = keys.distinct().repartitionByRange(shuffle_parts(keys), "doc_id").withColumn("_part", F.spark_partition_id())
    kept = written(ranged, "order")
    firsts = kept.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    after = Window.orderBy("_part")
    linked = firsts.select("_part", F.coalesce(F.lead("_first").over(after), F.min("_first").over(Window.partitionBy())).alias("_over"))
    inside = kept.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("_part").orderBy("doc_id")))
    return inside.join(linked, "_part").select("doc_id", F.coalesce("_next", "_over").alias("next_id"))


def fingerprint_documents(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Terms are the words between white space, weighted by their counts. The edited text has its last floor(n / 2) code points
    replaced by the first as many of the next document by doc_id. A null text is empty; texts without words have a
    fingerprint of zeros and are alike. Rows that share a doc_id are each a row of the result, with the next
    larger id as their follower; where the follower's id is shared, its least text counts. An empty table gives no rows; a single
    document follows itself. Rows without a doc_id come first in the order, as one id.
    """
    kind = documents.schema["doc_id"].dataType
    # The order works on a key without nulls. Both joins below move this one narrow table, so its texts are shuffled once.
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    follow = _following(keyed.select(F.col("_key").alias("doc_id")))
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")

    # What the document before each needs of it: at most half of that document's length goes along.
    need = keyed.groupBy("_key").agg(F.max(half).alias("_need")).join(follow, F.col("_key") == F.col("doc_id")).select(F.col("next_id").alias("_key"), F.col("_key").alias("_asker"), "_need")
    heads = keyed.join(need.hint("shuffle_merge"), "_key").select("_asker", F.substring(F.col("text"), F.lit(1), F.col("_need")).alias("_head"))
    heads = heads.groupBy("_asker").agg(F.min("_head").alias("_head"))
    both = keyed.join(heads.withColumnRenamed("_asker", "_key").hint("shuffle_merge"), "_key")
    # The row number only tells rows of one key apart inside this stage.
    rows = both.select(
        "_key", F.monotonically_increasing_id().alias("_row"), "text", n_chars.alias("n_chars"), F.substring(F.col("text"), F.lit(1), n_chars - half).alias("_left"),
        F.substring(F.col("_head"), F.lit(1), half).alias("_right"))
    edited = F.concat("_left", "_right")
    # Words up to the last white space of what both texts share are met once.
    cut = rows.withColumn("edited", edited).withColumn("_common", F.regexp_extract("_left", rf"(?s)^.*{BLANK}", 0)).withColumn("_at", F.char_length("_common") + 1)
    cut = cut.withColumn("_sha", F.sha2(F.col("edited").cast("binary"), 256))
    digest = [F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10) for i in range(4)]
    pieces = [(3, F.col("_common")), (1, F.substring(F.col("text"), F.col("_at"), F.col("n_chars"))), (2, F.substring(F.col("edited"), F.col("_at"), F.col("n_chars")))]
    numbers = [(4 + i, x) for i, x in enumerate([F.col("n_chars").cast("string"), *digest])]
    texts = cut.select("_key", "_row", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), t.alias("t")) for e, t in pieces + numbers])).alias("_t"))
    words = texts.select("_key", "_row", F.col("_t.e").alias("_e"), F.explode(F.split(F.col("_t.t"), BLANK)).alias("_w")).where("_w <> ''")
    tag = F.greatest(F.col("_e") - 3, F.lit(0))
    hashed = words.select("_key", "_row", tag.alias("_tag"), "_e", F.when(F.col("_e") > 3, F.col("_w").cast("long")).otherwise(F.xxhash64("_w")).alias("term"))
    own, other = F.when(F.col("_tag") > 0, 1).otherwise(F.col("_e") % 2), F.when(F.col("_tag") > 0, 1).otherwise(F.floor(F.col("_e") / 2).cast("int"))
    sides = ("fingerprint", "edited_fingerprint")
    counted = hashed.groupBy("_key", "_row", "_tag", "term").agg(F.sum(own).alias(sides[0]), F.sum(other).alias(sides[1]))
    marks = signed(counted, ["_key", "_row"], sides, samples, len(numbers))
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.col("_notes")[i])), 16, "0") for i in range(1, 5)])
    own = written(marks.select(
        "_key", F.when(F.col("_key") != _NO_ID, F.col("_key")).cast(kind).alias("doc_id"), F.col("_notes")[0].alias("n_chars"), sha.alias("edited_sha256"),
        "fingerprint", "edited_fingerprint"), "marks")

    follower = own.groupBy("_key").agg(F.min("fingerprint").alias("_theirs"))
    asked = follow.select(F.col("doc_id").alias("_asker"), F.col("next_id").alias("_key")).join(follower, "_key").select(F.col("_asker").alias("_key"), "_theirs")
    return own.join(asked, "_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_theirs"), samples).alias("near_next"))
