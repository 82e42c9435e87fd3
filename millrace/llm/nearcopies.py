"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

The graph has one node per different shingle set, so copies of a document never meet each other. In a bucket, members are
first verified against one pivot only, which settles large groups of near copies in linear work. What such a group leaves
open is the pairs of different groups that share a bucket. Jaccard distance is a metric, so members of the pivot's group
that lie nearer to it, by more than the link distance, than every outsider are ruled out exactly. The members left
are compared by their signatures, in blocks of bounded size: first only those are sought that have any partner that may be
similar enough; then these meet with their full sets, and are verified inside the blocks. A block gives no more links
than join its groups, so what leaves it grows with its members, not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, written

WORDS = 5
#: Similarity of a link, in hundredths.
PERCENT = 75
#: 48 bands of 6: a pair at the threshold is missed with probability 8e-5, one at 0.8 with 5e-7.
BANDS, ROWS = 48, 6
#: Members per side of a block in which signatures are compared, and the share of equal components from which on a pair is
#: verified: 4 standard deviations below the threshold, so 5 of 100,000 pairs at the threshold itself fall below it.
BLOCK, MAYBE = 1024, 0.64
#: Shingles per side of a block in which full sets are compared.
BLOCK_SHINGLES = 1 << 20
#: Shingles whose permutations are drawn at once, and sets from which on they are traced back instead of kept, both for
#: signatures of BANDS * ROWS components.
CHUNK, LARGE = 20_000, 256

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(0x100000001B3, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (fixed, published constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its shingles of five words, from one prefix sum over the text's bytes."""

    def __init__(self) -> None:
        self.up = _powers(0x100000001B3, 1 << 16)
        self.down = _powers(_INVERSE, 1 << 16)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        if len(raw) >= len(self.up):
            size = 2 * len(raw)
            self.up, self.down = _powers(0x100000001B3, size), _powers(_INVERSE, size)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        k = min(WORDS, len(words))
        first, last = starts[: len(words) - k + 1], ends[k - 1 :]
        hashes = _mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64) * np.uint64(_ODD))
        return np.unique(hashes)


def _draw(hashes: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per shingle: where this level's element of the shuffle comes from (level..size-1), and 32 bits for its value."""
    x = _mixed(hashes + np.uint64((level + 1) * _ODD & (1 << 64) - 1))
    place = ((x >> np.uint64(32)) * np.uint64(size - level)) >> np.uint64(32)
    return place.astype(np.int64) + level, x & np.uint64(0xFFFFFFFF)


def _sign_small(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures of several sets at once; each shingle keeps its whole permutation."""
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    hashes = np.concatenate(sets)
    shuffle = np.tile(np.arange(size, dtype=np.uint16), (len(hashes), 1))
    flat = np.full(len(sets) * size, np.uint64((1 << 64) - 1))
    for level in range(size):
        place, value = _draw(hashes, level, size)
        rows = np.arange(len(hashes))
        target = shuffle[rows, place].astype(np.int64)
        shuffle[rows, place] = shuffle[:, level]
        np.minimum.at(flat, owner * size + target, value | np.uint64(level << 32))
        # Early stop: once every component is below the next level, later ranks cannot lower it.
        open_sets = flat.reshape(len(sets), size).max(axis=1) >= np.uint64(level + 1 << 32)
        going = open_sets[owner]
        if not going.all():
            if not going.any():
                break
            hashes, owner, shuffle = hashes[going], owner[going], shuffle[going]
    return flat.reshape(len(sets), size)


def _sign_large(hashes: np.ndarray, size: int) -> np.ndarray:
    """The same for one large set, which needs few levels: a place is traced back through the swaps made before."""
    out = np.full(size, np.uint64((1 << 64) - 1))
    swaps: list[np.ndarray] = []
    for level in range(size):
        place, value = _draw(hashes, level, size)
        target = place
        for i in range(level - 1, -1, -1):
            target = np.where(swaps[i] == target, i, target)
        swaps.append(place)
        np.minimum.at(out, target, value | np.uint64(level << 32))
        if out.max() < np.uint64(level + 1 << 32):
            break
    return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set: per shingle one shuffle of the components, component value rank + fraction, least value kept.

    Ranks run level by level over all shingles, which gives the same minima as shingle by shingle. An empty set's row is
    all ones.
    """
    out = np.full((len(sets), size), np.uint64((1 << 64) - 1))
    block: list[int] = []
    held, short = 0, BANDS * ROWS

    def flush() -> None:
        nonlocal block, held
        if block:
            out[block] = _sign_small([sets[i] for i in block], size)
        block, held = [], 0

    for i, s in enumerate(sets):
        if len(s) * short >= LARGE * size:
            out[i] = _sign_large(s, size)
        elif len(s):
            block.append(i)
            held += len(s)
            if held * size >= CHUNK * short:
                flush()
    flush()
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_ODD), parts.shape[:2])
    for r in range(rows):
        keys = _mixed(keys ^ parts[:, :, r] * np.uint64(0xD6E8FEB86659FD93))
    return keys.astype(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame) -> DataFrame:
    """(id, text) -> (_id, n, cls, keys, sig): the set's size and digest, its band keys, and one byte per component.

    cls, keys and sig are null for an empty set.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = [shingle(t) for t in batch.column(1).to_pylist()]
                components = signatures(sets)
                keys, low = band_keys(components, BANDS, ROWS), components.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     *(pa.array([x.tobytes() if len(s) else None for x, s in zip(of, sets, strict=True)], pa.binary()) for of in (keys, low))],
                    names=["_id", "n", "cls", "keys", "sig"])
        give_back()

    schema = T.StructType([docs.schema[0], T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("cls", "keys", "sig"))])
    schema.fields[0] = T.StructField("_id", docs.schema[0].dataType)
    return written(docs.mapInArrow(sign, schema), "signed", "lz4")


def _pivot_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): the pivot of a bucket, its least node, with each other node of the bucket; once, however many bands they share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["key", "node"])

    rows = classes.select("node", "keys").mapInArrow(split, "key long, node long")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("a")).where("_n > 1").select("key", "a")
    met = rows.join(shared.hint("shuffle_merge"), "key").where("a <> node")
    return met.select("a", F.col("node").alias("b")).distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the wanted nodes, each from the text of the document that stands for it."""
    # Rows that share an id but not the text are told apart by the set's digest.
    texts = docs.join(wanted.hint("shuffle_merge"), docs["_id"].eqNullSafe(wanted["rep"])).select("node", "cls", "_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            nodes, sets = [], []
            for node, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle(text)
                if len(s) and _digest(s) == cls:
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(shingled, "node long, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of the full sets of each pair."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            both, either = [], []
            for a, sa, sb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, mine = a, np.frombuffer(sa.as_buffer(), np.uint64)
                other = np.frombuffer(sb.as_buffer(), np.uint64)
                at = np.searchsorted(mine, other)
                n = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
                both.append(n)
                either.append(len(mine) + len(other) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    joined = pairs.join(right.hint("shuffle_merge"), "b").join(left.hint("shuffle_merge"), "a").select("a", "b", "_sa", "_sb")
    return joined.mapInArrow(compare, "a long, b long, both long, either long")


def grouped(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of ``links`` (a, b).

    Union-find inside every task first leaves at most one link per node and task. Then, round by round, every node's larger
    neighbours and the node itself are linked to its least neighbour, until nothing changes; the rounds grow with the logarithm of
    the longest chain.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

    edges = written(links.select("a", "b").mapInArrow(forest, "a long, b long").where("a <> b"), "forest")
    seen = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The (p, node, d, label) of ``rows`` that still have something to compare: what met the pivot ``p`` in any bucket.

    Buckets with the same pivot are one here, so a node is asked once per pivot, not once per band; pairs that met in no
    bucket may then be compared too, which loses none. All members were compared with ``p``, at the distance ``d``. A member of
    p's group goes if it is nearer to p, by more than the link distance, than every member of another group: it can be linked with none
    of them. A pivot goes when its members left are one group.
    """
    of_first = labels.select(F.col("node").alias("p"), F.col("label").alias("_pl"))
    known = _labelled(rows.select("p", "node", "d"), labels).join(of_first, "p", "left")
    known = known.withColumn("_mine", F.col("label") == F.coalesce("_pl", "p"))
    outside = known.where(~F.col("_mine")).groupBy("p").agg(F.min("d").alias("_out"))
    link = 1 - PERCENT / 100
    left = known.join(outside, "p").where(~F.col("_mine") | (F.col("_out") - F.col("d") <= link + 1e-9)).select("p", "node", "d", "label")
    mixed = left.groupBy("p").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("p")
    return left.join(mixed, "p")


def _in_blocks(members: DataFrame, wide: DataFrame) -> GroupedData:
    """``members`` (p, node, label, n) in blocks (p, _l, _r): outsiders of their pivot's largest group on the left, all on the right.

    Both sides are dealt by their node into blocks of about ``BLOCK`` members, and with ``shingles`` of about ``BLOCK_SHINGLES`` of
    these, so one group of any size is met only by its outsiders. The columns of ``wide`` (node, sig, shingles) join by the node once
    blocks are planned, so no task holds those of a pivot's members.
    """
    carried = [c for c in wide.columns if c != "node"]
    load = F.greatest(F.lit(1 / BLOCK), F.col("n") / BLOCK_SHINGLES) if "shingles" in carried else F.lit(1 / BLOCK)
    sizes = members.groupBy("p", "label").agg(F.count(F.lit(1)).alias("_size"), F.sum(load).alias("_load"))
    largest = sizes.groupBy("p").agg(F.max(F.struct("_size", (-F.col("label")).alias("_neg"), "_load")).alias("_top"), F.sum("_load").alias("_all"))
    plan = largest.select(
        "p", (-F.col("_top._neg")).alias("_main"), F.ceil("_all").alias("_rights"),
        F.greatest(F.lit(1), F.ceil(F.col("_all") - F.col("_top._load"))).cast("long").alias("_lefts"))
    dealt = members.join(plan, "p").withColumn("main", F.col("label") == F.col("_main")).join(wide, "node")
    place, row = F.xxhash64("node"), ["node", "label", "main", "n", *carried]
    left = dealt.where("NOT main").select(
        "p", F.pmod(place, "_lefts").alias("_l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rights") - 1)).alias("_r"), F.lit(True).alias("_left"), *row)
    right = dealt.select(
        "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lefts") - 1)).alias("_l"), F.pmod(place, "_rights").alias("_r"), F.lit(False).alias("_left"), *row)
    return left.unionByName(right).groupBy("p", "_l", "_r")


def _maybe_alike(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block: a row of the left side, with the right rows of other groups whose signatures agree in ``MAYBE`` of their components.

    Sets that differ so much in size that they cannot be linked are left out. Two outsiders meet in two blocks, and are told of in
    that one where the left one's node is the smaller.
    """
    on_left, main = block["_left"].to_numpy(), block["main"].to_numpy()
    node, label, n = (block[c].to_numpy() for c in ("node", "label", "n"))
    sig = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
    (other,) = np.nonzero(~on_left)
    for i in np.flatnonzero(on_left):
        fits = 100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i])
        against = other[(label[other] != label[i]) & (main[other] | (node[other] > node[i])) & fits]
        near = against[(sig[against] == sig[i]).sum(axis=1) >= MAYBE * sig.shape[1]]
        if len(near):
            yield i, near


def _with_partner(members: DataFrame, wide: DataFrame) -> DataFrame:
    """The (p, node) of ``members`` (p, node, label, n) that may, by ``wide`` (node, sig), be linked with a member of another group."""

    def seek(block: pa.Table) -> pa.Table:
        found = np.zeros(block.num_rows, bool)
        for i, near in _maybe_alike(block):
            found[i] = found[near] = True
        return block.filter(pa.array(found)).select(["p", "node"])

    return _in_blocks(members, wide).applyInArrow(seek, "p long, node long").distinct()


def _block_links(members: DataFrame, wide: DataFrame) -> DataFrame:
    """(a, b): links between different groups of ``members`` (p, node, label, n), compared on full sets: ``wide`` (node, sig, shingles).

    A pair whose groups are joined by links of the same block needs no comparison, so each link given joins two groups that were apart.
    """

    def meet(block: pa.Table) -> pa.Table:
        node, label = block["node"].to_numpy(), block["label"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in block["shingles"].to_pylist()]
        parent, links = {x: x for x in label}, []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, near in _maybe_alike(block):
            mine = sets[i]
            near = [j for j in near if find(label[j]) != find(label[i])]
            # A few at a time, so that what the first ones join spares the rest.
            for lo in range(0, len(near), 16):
                some = [j for j in near[lo : lo + 16] if find(label[j]) != find(label[i])]
                if not some:
                    continue
                lengths = np.array([len(sets[j]) for j in some])
                theirs = np.concatenate([sets[j] for j in some])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
                for j in np.array(some)[100 * both >= PERCENT * (len(mine) + lengths - both)]:
                    one, two = find(label[i]), find(label[j])
                    if one != two:
                        parent[max(one, two)] = min(one, two)
                        links.append(sorted((node[i], node[j])))
        a, b = np.array(links, np.int64).reshape(-1, 2).T.copy()
        return pa.table({"a": a, "b": b})

    return _in_blocks(members, wide).applyInArrow(meet, "a long, b long").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_shingles, component_id, kept.

    Words are what lies between ASCII white space, A-Z in lower case; a set is the distinct shingles of five words, or the whole
    sequence as one if there are fewer. Documents are linked when 100 * common >= 75 * all shingles, compared on full sets;
    component_id is the smallest id reachable. A text that is null or without words has an empty set and is linked with nothing,
    not even with its like. Rows that repeat an id have one component; kept is true for each row whose id is its component's. A
    null id counts as the largest. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    signed = _signed(docs)
    classes = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes", "lz4")
    pairs = written(_pivot_pairs(classes), "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_sets_of(docs, classes.select("node", "cls", "rep").join(met, "node")), "sets", "lz4")
    tested = written(_verified(pairs, sets), "tested")
    linked = f"100 * both >= {PERCENT} * either"
    labels = written(grouped(tested.where(linked)), "labels")

    # Pivots whose members are one group by now are done; of the others, members of different groups are compared in blocks.
    left = tested.select(F.col("a").alias("p"), F.col("b").alias("node"), (1 - F.col("both") / F.col("either")).alias("d"))
    left = written(_still_open(left, labels).join(classes.select("node", "n"), "node").drop("d"), "open")
    if not left.isEmpty():
        signs = classes.select("node", "sig")
        left = left.join(written(_with_partner(left, signs), "partnered"), ["p", "node"])
        more = written(_block_links(left, signs.join(sets, "node")), "linked")
        labels = written(grouped(tested.where(linked).select("a", "b").unionByName(more)), "labels")

    named = _labelled(classes.select("cls", "node", "rep"), labels)
    components = named.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = named.join(components, "label").select("cls", "component")
    out = signed.drop("keys", "sig").join(of_class, "cls", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which no near-duplicate with a smaller id exists in their component, with their own columns."""
    own = df.columns
    keep = near_copies(df, id_col, text_col).where("kept").select(F.col(id_col).alias("_keep")).distinct()
    whole = df.select(F.col(id_col).alias("_id"), F.struct("*").alias("_whole"))
    return whole.join(keep, whole["_id"].eqNullSafe(keep["_keep"])).select(*[F.col("_whole")[c].alias(c) for c in own])
