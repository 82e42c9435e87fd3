"""Language identification with interpolated Kneser-Ney character models kept in sorted hash arrays."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, shared_fs, shuffle_parts, written
from millrace.session import new_path

ORDER = 4
#: Entries of the model's tables in a block, and blocks that a worker keeps open: at most 160 MB where they cannot be mapped.
BLOCK, BLOCKS_KEPT = 1 << 15, 256
#: Distinct words a worker counts before it hands them on; words whose bits it remembers, and those of them, the first met, that
#: it keeps when they are too many: about 200 bytes a word. Words scored, and texts taken out of Arrow, at a time.
COUNTED, REMEMBERED, KEPT = 100_000, 200_000, 80_000
SCORED, TEXTS = 8192, 256
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
#: Half-bit cells of the cross-entropy above a language's own, for the calibrated rejection.
CELLS, CELL_BITS = 64, 0.25
#: Share of the calibration documents that a language's limit must cover, the part of the way from there to the bits of
#: evenly drawn letters that is put on top, and the bits for short texts (divided by the root of the length).
COVER, MARGIN, SHORT = 0.999, 0.5, 8.0

_WORDS = re.compile(r"[^\W\d_]+")
_EDGE = "\x02"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter (the expression also takes numerals such as superscripts)."""
    words = _WORDS.findall(text.lower())
    if words and not words[0].isalpha() and not any(c.isalpha() for c in text):
        return []
    return words


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` codes that end at each place from ``length - 1`` on."""
    n = len(codes) - length + 1
    h = np.full(max(n, 0), length, np.uint64)
    for i in range(length):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Tables:
    """(hash, language, value) entries of each kind in the order of hash and language, looked up by hash.

    Kind ``2 * (k - 1)`` has the whole probabilities of grams of k symbols, the next one the back-off weights of their contexts.
    The entries lie in blocks below ``folder``; ``blocks`` has (lowest hash, file, place, entries) of each, in order. Workers map the
    blocks they need into memory, or read them where the folder is remote. ``held`` has whole kinds in memory instead.
    """

    def __init__(self, width: int, blocks: dict[int, list[tuple[int, str, int, int]]], folder: str, held: dict[int, tuple] | None = None):
        self.width, self.blocks, self.folder, self.held = width, blocks, folder, held
        self._remember()

    def _remember(self) -> None:
        self.lows = {kind: np.array([b[0] for b in found], np.int64) for kind, found in self.blocks.items()}
        self.block = lru_cache(maxsize=BLOCKS_KEPT)(self._block)
        self.file = lru_cache(maxsize=64)(self._file)

    def __getstate__(self) -> tuple:
        return self.width, self.blocks, self.folder, self.held

    def __setstate__(self, state: tuple) -> None:
        self.width, self.blocks, self.folder, self.held = state
        self._remember()

    def _file(self, name: str):
        system, base = shared_fs(self.folder, mapped=True)
        return system.open_input_file(f"{base}/{name}")

    def _block(self, kind: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held is not None:
            return self.held[kind]
        _, name, at, n = self.blocks[kind][i]
        f = self.file(name)
        f.seek(at)
        raw = f.read_buffer(20 * n)
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 16 * n), np.frombuffer(raw, "<f8", n, 8 * n)

    def look(self, kind: int, wanted: np.ndarray, absent: float) -> np.ndarray:
        """One row per hash of ``wanted`` with the value of each language, ``absent`` where there is no entry."""
        hashes, places = np.unique(wanted.view(np.int64), return_inverse=True)
        out = np.full((len(hashes), self.width), absent)
        if kind in self.lows and len(hashes):
            of = np.maximum(np.searchsorted(self.lows[kind], hashes, "right") - 1, 0)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                keys, langs, values = self.block(kind, int(of[lo]))
                first, last = (np.searchsorted(keys, hashes[lo:hi], side) for side in ("left", "right"))
                many = last - first
                at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                out[np.repeat(np.arange(lo, hi), many), langs[at]] = values[at]
        return out[places]


@dataclass
class Model:
    langs: list[str]
    order: int
    floor: float
    tables: Tables
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def bits(self, words: list[str]) -> np.ndarray:
        """Minus log2 of each word's probability under each language, the end of the word included.

        The longest gram that ends at a symbol and that the language knows has the whole probability; each order above it
        contributes the back-off weight of its context.
        """
        if not words:
            return np.zeros((0, len(self.langs)))
        lengths = np.array([len(w) + 1 for w in words])
        codes = _codes(_EDGE + _EDGE.join(words) + _EDGE)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        depth = np.arange(len(codes) - 1) - np.repeat(starts, lengths) + 1  # symbols since the edge, this one excluded
        p = np.zeros((len(codes) - 1, len(self.langs)))
        weight = np.ones_like(p)
        for k in range(self.order, 0, -1):
            at = np.flatnonzero((depth >= k - 1) & (p == 0).any(axis=1))
            p[at] = np.where(p[at] == 0, self.tables.look(2 * (k - 1), _hashes(codes, k)[at - k + 2], 0.0), p[at])
            missed = at[(p[at] == 0).any(axis=1)]
            back = _hashes(codes, k - 1)[missed - k + 2] if k > 1 else np.zeros(len(missed), np.uint64)
            weight[missed] *= np.where(p[missed] == 0, self.tables.look(2 * (k - 1) + 1, back, 1.0), 1.0)
        return -np.add.reduceat(np.log2(np.where(p == 0, self.floor, p) * weight), starts, axis=0)

    def limit(self, lang: int, symbols: int) -> float:
        """The cross-entropy above which a text of so many symbols is rejected: short texts spread wider."""
        return np.inf if self.limits is None else self.limits[lang] + SHORT / np.sqrt(symbols)


def _kneser_ney(counts: dict[str, int], order: int) -> list[tuple[dict[str, float], dict[str, float]]]:
    """(gain of each gram, back-off weight of each context) per order, from the counts of the longest grams.

    A shorter gram in ``counts`` begins at the edge of a word. Below the longest order, a gram counts once per different
    symbol before it; at the edge nothing comes before, so its own count holds.
    """
    levels = []
    current = {g: c for g, c in counts.items() if len(g) == order}
    for k in range(order, 0, -1):
        ones, twos = (sum(1 for c in current.values() if c == n) for n in (1, 2))
        discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        total, types = defaultdict(int), defaultdict(int)
        for g, c in current.items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        gains = {g: max(c - discount, 0.0) / total[g[:-1]] for g, c in current.items()}
        kept = defaultdict(float)
        for g, gain in gains.items():
            kept[g[:-1]] += gain
        levels.append((gains, {h: max(1.0 - kept[h], 1e-6) for h in total}))
        below = Counter(g[1:] for g in current)
        below.update({g: c for g, c in counts.items() if len(g) == k - 1 and g.startswith(_EDGE) and len(g) > 1})
        current = {g: c for g, c in below.items() if g}
    return levels[::-1]


def build_model(rows: Iterable[tuple[str, str, int]], order: int = ORDER) -> Model:
    """The model of (lang, gram, count) rows; the languages are those with a row, in code-point order."""
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in rows:
        counts[lang][gram] = int(n)
    langs = sorted(counts)
    alphabet = {c for lang in langs for g in counts[lang] for c in g}
    floor = 1.0 / (len(alphabet) + 1)
    found: dict[int, list[tuple[str, int, float]]] = {kind: [] for kind in range(2 * order)}
    for j, lang in enumerate(langs):
        lower = defaultdict(lambda: floor)
        for k, (gains, back) in enumerate(_kneser_ney(counts[lang], order)):
            lower = {g: gain + back[g[:-1]] * lower[g[1:]] for g, gain in gains.items()}
            found[2 * k] += [(g, j, v) for g, v in lower.items()]
            found[2 * k + 1] += [(h, j, v) for h, v in back.items()]
    held = {}
    for kind, entries in found.items():
        keys, ids, values = _gram_hashes([e[0] for e in entries], kind), np.array([e[1] for e in entries], np.int32), np.array([e[2] for e in entries], np.float64)
        by = np.lexsort((ids, keys))
        held[kind] = keys[by], ids[by], values[by]
    return Model(langs, order, floor, Tables(len(langs), {kind: [(0, "", 0, 0)] for kind in held}, "", held))


def _gram_hashes(grams: list[str], kind: int) -> np.ndarray:
    width = kind // 2 + 1 - kind % 2
    return (_hashes(_codes("".join(grams)), width)[::width] if width and grams else np.zeros(len(grams), np.uint64)).view(np.int64)


def spread_model(counts: DataFrame, order: int = ORDER) -> Model | None:
    """The model that ``build_model`` gives of all (lang, gram, n) rows, computed by Spark; None without rows.

    The driver gets the languages, the number of symbols and one row per block of the tables, nothing per gram.
    """
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    length, context, tail = F.char_length("gram"), F.expr("substr(gram, 1, char_length(gram) - 1)"), F.expr("substr(gram, 2)")
    levels = []
    current = counts.where(length == order).select("lang", "gram", F.col("n").alias("c"))
    for k in range(order, 0, -1):
        seen = [F.sum((F.col("c") == n).cast("double")) for n in (1, 2)]
        raw = F.when(seen[0] > 0, seen[0] / (seen[0] + 2 * seen[1])).otherwise(0.5)
        discounts = current.groupBy("lang").agg(F.least(F.greatest(raw, F.lit(0.1)), F.lit(0.9)).alias("discount"))
        # One row per language.
        cut = current.join(F.broadcast(discounts), "lang").select("lang", "gram", context.alias("context"), "c", F.greatest(F.col("c") - F.col("discount"), F.lit(0.0)).alias("rest"))
        contexts = written(cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("rest").alias("kept")).select(
            "lang", "context", "total", F.greatest(1 - F.col("kept") / F.col("total"), F.lit(1e-6)).alias("back")), f"contexts-{k}")
        levels.append((cut, contexts))
        if k > 1:
            below = current.groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            edge = counts.where((length == k - 1) & (length > 1) & F.col("gram").startswith(_EDGE)).select("lang", "gram", F.col("n").alias("c"))
            current = written(below.unionByName(edge), f"continuations-{k - 1}")
    # Every symbol ends some gram, so it is among the shortest ones; so is the edge.
    floor = 1.0 / (current.select("gram").distinct().count() + 1)
    entries, lower = [], None
    for k, (cut, contexts) in enumerate(reversed(levels), start=1):
        # The only context of single symbols is the empty one: a row per language.
        joined = cut.join(F.broadcast(contexts) if k == 1 else contexts, ["lang", "context"])
        gain = F.col("rest") / F.col("total")
        if lower is None:
            whole = joined.select("lang", "gram", (gain + F.col("back") * floor).alias("value"))
        else:
            shorter = lower.select("lang", F.col("gram").alias("tail"), F.col("value").alias("shorter"))
            # Of single symbols there are at most an alphabet for each language.
            shorter = F.broadcast(shorter) if k == 2 else shorter
            whole = joined.withColumn("tail", tail).join(shorter, ["lang", "tail"]).select("lang", "gram", (gain + F.col("back") * F.col("shorter")).alias("value"))
        lower = written(whole, f"probabilities-{k}")
        entries.append(lower.select(F.lit(2 * (k - 1)).alias("kind"), "gram", "lang", "value"))
        entries.append(contexts.select(F.lit(2 * (k - 1) + 1).alias("kind"), F.col("context").alias("gram"), "lang", F.col("back").alias("value")))
    return Model(langs, order, floor, _write_tables(reduce(DataFrame.unionByName, entries), langs))


def _write_tables(entries: DataFrame, langs: list[str]) -> Tables:
    """(kind, gram, lang, value) rows as blocks of at most ``BLOCK`` entries or so below a fresh folder; a hash is in one block only.

    File names are unique per attempt, and only what a finished task reports is in the result.
    """
    folder = new_path(entries.sparkSession, "language-model")
    place = {lang: i for i, lang in enumerate(langs)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, grams = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            hashes = np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                hashes[kinds == kind] = _gram_hashes(list(grams[kinds == kind]), int(kind))
            ids = pa.array([place[x] for x in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes), ids, batch.column(3)], names=["kind", "hash", "lang", "value"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = shared_fs(folder)
        system.create_dir(base, recursive=True)
        name, at, out, blocks = uuid.uuid4().hex, 0, None, []

        def flush(kinds: np.ndarray, hashes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
            nonlocal at, out
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            raw = hashes.astype("<i8").tobytes() + values.astype("<f8").tobytes() + ids.astype("<i4").tobytes()
            out.write(raw + bytes(-len(raw) % 8))
            blocks.append((int(kinds[0]), int(hashes[0]), name, at, len(hashes)))
            at += len(raw) + -len(raw) % 8

        rest = [np.zeros(0, t) for t in (np.int32, np.int64, np.int32, np.float64)]
        for batch in batches:
            rest = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            # Places where another kind or hash begins; what follows the last one waits for the next batch.
            begins = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0)) + 1
            turns = set((np.flatnonzero(np.diff(rest[0])) + 1).tolist())
            done = 0
            for b in begins.tolist():
                if b in turns or b - done >= BLOCK:
                    flush(*[r[done:b] for r in rest])
                    done = b
            rest = [r[done:] for r in rest]
        if len(rest[0]):
            flush(*rest)
        if out is not None:
            out.close()
        columns = list(zip(*blocks, strict=True)) if blocks else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["kind", "low", "file", "at", "n"])

    rows = written(entries.mapInArrow(hashed, "kind int, hash long, lang int, value double"), "hashed")
    ranged = rows.repartitionByRange(shuffle_parts(rows), "kind", "hash").sortWithinPartitions("kind", "hash", "lang")
    blocks: dict[int, list[tuple[int, str, int, int]]] = defaultdict(list)
    for kind, *block in written(ranged.mapInArrow(put, "kind int, low long, file string, at long, n long"), "blocks").collect():
        blocks[kind].append(tuple(block))
    return Tables(len(langs), {kind: sorted(found) for kind, found in blocks.items()}, folder)


class _Numbers(dict):
    """Word -> its number; a new word takes the next one and waits in ``new``."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__(zip(words, count()))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Cross-entropies of texts; remembers the bits of words met before.

    Above ``REMEMBERED`` words, the ``KEPT`` that were met first stay: common words are met early.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known = _Numbers()
        self.table = np.zeros((1024, len(model.langs)))

    def _learn(self) -> None:
        new, self.known.new = self.known.new, []
        first = len(self.known) - len(new)
        if len(self.known) > len(self.table):
            table = np.empty((max(len(self.known), 2 * len(self.table)), self.table.shape[1]))
            table[:first] = self.table[:first]
            self.table = table
        for lo in range(0, len(new), SCORED):
            self.table[first + lo : first + lo + SCORED][: len(new) - lo] = self.model.bits(new[lo : lo + SCORED])

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, int] | None]:
        """Bits per symbol under each language, and the number of symbols; None for a text without a letter."""
        for lo in range(0, len(texts), TEXTS):
            if len(self.known) > REMEMBERED:
                self.known = _Numbers(list(islice(self.known, KEPT)))
            block, symbols = [], []
            for text in texts.slice(lo, TEXTS).to_pylist():
                words = words_of(text) if text else []
                block.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
                symbols.append(sum(map(len, words)) + len(words))
            self._learn()
            for ids, n in zip(block, symbols, strict=True):
                yield (self.table[ids].sum(axis=0) / n, n) if n else None


def learned(doc_id: Column) -> Column:
    """Whether a document may be learned from; every third is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def calibrating(doc_id: Column) -> Column:
    """The learnable documents kept back from the counts to calibrate on: one in five of them or so."""
    return F.coalesce(F.crc32(F.concat(F.lit("calibrate:"), doc_id.cast("string")).cast("binary")) % 5 == 0, F.lit(False))


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over every word of every row: grams of ``order`` symbols, and the shorter ones at a word's start.

    Words are counted inside the tasks first, in tables of bounded size, so a language of any share moves few rows.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter[str]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "word", "n"])
            counts.clear()

        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts[lang].update(words_of(text))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from flush()
        yield from flush()
        give_back()

    by_word = labelled.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(_EDGE), "word", F.lit(_EDGE))
    ends = by_word.select("lang", "n", padded.alias("p"), F.explode(F.sequence(F.lit(2), F.char_length("word") + 2)).alias("e"))
    first = F.greatest(F.lit(1), F.col("e") - order + 1)
    return ends.groupBy("lang", F.col("p").substr(first, F.col("e") - first + 1).alias("gram")).agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, order: int = ORDER) -> Model | None:
    """The calibrated model of (doc_id, text, lang) rows, or None if nothing can be learned.

    A first model of all learnable texts but those kept back judges these: they give, per language, how far their own
    cross-entropy spreads (cells of ``CELL_BITS``), and the temperature at which the softmax of the cross-entropies is the best
    forecast of the label. The model itself has every gram of all learnable texts, and every language of theirs; one that
    the first model does not know has no limit.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned(F.col("doc_id")))
    kept_back = usable.where(calibrating(F.col("doc_id")))
    first = written(gram_counts(usable.where(~calibrating(F.col("doc_id"))), order), "grams")
    counts = first.unionByName(gram_counts(kept_back, order)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model, trial = spread_model(written(counts, "all-grams"), order), spread_model(first, order)
    if model is not None and trial is not None:
        _calibrate(model, trial, kept_back)
    return model


def _calibrate(model: Model, trial: Model, kept_back: DataFrame) -> None:
    """Set the temperature and the limits of ``model`` by what ``trial`` makes of the documents kept back."""
    spark = kept_back.sparkSession
    sent = spark.sparkContext.broadcast(trial)
    n_t = len(TEMPERATURES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        place = {lang: i for i, lang in enumerate(sent.value.langs)}
        cells = np.zeros((len(place), CELLS), np.int64)
        fit_at = np.zeros(n_t)
        for batch in batches:
            for lang, scored in zip(batch.column(0).to_pylist(), scorer(batch.column(1)), strict=True):
                if scored is None or lang not in place:
                    continue
                h = scored[0]
                cells[place[lang], min(int(h[place[lang]] / CELL_BITS), CELLS - 1)] += 1
                for t, heat in enumerate(TEMPERATURES):
                    fit_at[t] += np.log(_softmax(-h * heat)[place[lang]] + 1e-12)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*np.repeat(np.arange(len(place)), CELLS), *([-1] * n_t)], pa.int64()), pa.array([*np.tile(np.arange(CELLS), len(place)), *range(n_t)], pa.int64()),
             pa.array([*cells.ravel().astype(float), *fit_at], pa.float64())], names=["lang", "cell", "v"])
        del scorer
        give_back()

    found = kept_back.select("lang", "text").mapInArrow(spread, "lang long, cell long, v double").groupBy("lang", "cell").agg(F.sum("v").alias("v")).collect()
    cells, fits = np.zeros((len(trial.langs), CELLS)), np.zeros(n_t)
    for lang, cell, v in found:
        if lang < 0:
            fits[cell] = v
        else:
            cells[lang, cell] = v
    model.temperature = TEMPERATURES[int(np.argmax(fits))] if fits.any() else 1.0
    share = np.cumsum(cells, axis=1) / np.maximum(cells.sum(axis=1, keepdims=True), 1)
    own = (np.argmax(share >= COVER, axis=1) + 1) * CELL_BITS
    limit = own + MARGIN * np.maximum(-np.log2(model.floor) - own, 1.0)
    limits = dict(zip(trial.langs, np.where(cells.sum(axis=1) > 0, limit, np.inf), strict=True))
    model.limits = np.array([limits.get(lang, np.inf) for lang in model.langs])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with lang_pred, score and rejected; only ``text`` is looked at, and all of it.

    lang_pred is the language with the lowest cross-entropy per symbol, the first by code point on a tie; ``und`` with score
    0 if the text is null, has no letter, or nothing was learned. score is the calibrated softmax. rejected marks
    ``und`` and texts whose cross-entropy is above the limit of their language. Columns of these names are replaced;
    all others stay as they are. Repeated rows give repeated results; an empty table gives no rows.
    """
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    packed = documents.select(F.struct(*[documents[c] for c in kept]).alias("_row"))
    at = next(i for i, c in enumerate(kept) if c.lower() == "text")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m) if m else None
        for batch in batches:
            preds, scores, rejects = [], [], []
            texts = batch.column(0).field(at)
            for scored in scorer(texts) if scorer else [None] * len(texts):
                if scored is None:
                    preds.append("und")
                    scores.append(0.0)
                    rejects.append(True)
                else:
                    h, symbols = scored
                    best = int(np.argmin(h))
                    preds.append(m.langs[best])
                    scores.append(float(_softmax(-h * m.temperature)[best]))
                    rejects.append(bool(h[best] > m.limit(best, symbols)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())],
                names=["_row", "lang_pred", "score", "rejected"])
        del scorer
        give_back()

    schema = packed.select("_row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return packed.mapInArrow(judge, schema).select(*[F.col("_row")[c].alias(c) for c in kept], "lang_pred", "score", "rejected")


def identify_documents(documents: DataFrame) -> DataFrame:
    """Learn from the documents that may be learned from, then predict all of them."""
    model = fit(documents.select("doc_id", "text", "lang"))
    slim = documents.select("doc_id", "text", (~learned(F.col("doc_id"))).alias("held_out"))
    return identify(slim, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
