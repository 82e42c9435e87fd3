"""The pipeline, the calibration of the language models and the fingerprints, each against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import fingerprints, langid
from millrace.llm.queries import tokenizer_path
from tests.llm.test_operators import SCHEMA, brute_components, grams_of, words

WORD = r"[^\x20\x09-\x0D]+"
POOLS = {
    "aa": ["baba", "mama", "lala", "bala", "malba", "abam", "lamab", "bamla", "alab", "mabal", "laba", "amla"],
    "zz": ["xyxo", "zuzo", "quxo", "yzuq", "oxuz", "zyxo", "uzoq", "qyzo", "xoxu", "zoqy", "uxyz", "oqzu"]}


# ---- language models, by definition


def crc(text):
    return zlib.crc32(text.encode())


def learnable(i):
    return crc(str(i)) % 3 != 1


def kept_back(i):
    return crc(f"calibrate:{i}") % 5 == 0


class BruteModel:
    """Interpolated Kneser-Ney over the words of the given (text, lang) rows."""

    def __init__(self, rows):
        self.counts = {}
        for text, lang in rows:
            self.counts.setdefault(lang, Counter()).update(grams_of(langid.words_of(text)))
        self.counts = {lang: c for lang, c in self.counts.items() if c}
        self.langs = sorted(self.counts)
        self.alphabet = len({c for counts in self.counts.values() for g in counts for c in g})
        self.chances = [self._chance(self.counts[lang]) for lang in self.langs]

    def _chance(self, counts, order=4):
        use = {order: {g: c for g, c in counts.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            befores = {}
            for h in use[k + 1]:
                befores.setdefault(h[1:], set()).add(h[0])
            use[k] = {g: len(x) for g, x in befores.items()}
            use[k].update({g: c for g, c in counts.items() if len(g) == k > 1 and g[0] == "\x02"})
        discounts, after = {}, {}
        for k, level in use.items():
            n1, n2 = (sum(c == n for c in level.values()) for n in (1, 2))
            discounts[k] = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
            for h, c in level.items():
                after.setdefault((k, h[:-1]), []).append(c)

        @lru_cache(None)
        def chance(g):
            if not g:
                return 1 / (self.alphabet + 1)
            d, follow = discounts[len(g)], after.get((len(g), g[:-1]))
            if not follow:
                return chance(g[1:])
            spared = max(1 - sum(max(c - d, 0) for c in follow) / sum(follow), 1e-6)
            return max(use[len(g)].get(g, 0) - d, 0) / sum(follow) + spared * chance(g[1:])

        return chance

    def entropy(self, text):
        """Bits per symbol under each language and the number of symbols, or None without a letter."""
        found = langid.words_of(text) if text else []
        if not found:
            return None
        symbols = sum(len(w) + 1 for w in found)
        bits = [-sum(math.log2(chance(p[max(0, e - 3) : e + 1])) for p in (f"\x02{w}\x02" for w in found) for e in range(1, len(p))) for chance in self.chances]
        return [b / symbols for b in bits], symbols


def brute_calibration(rows):
    """(model, temperature, limit of each language) from (doc_id, text, lang) rows."""
    usable = [(i, t, lang) for i, t, lang in rows if lang is not None and t is not None and learnable(i)]
    model = BruteModel([(t, lang) for _, t, lang in usable])
    trial = BruteModel([(t, lang) for i, t, lang in usable if not kept_back(i)])
    heard, fits = {lang: [] for lang in trial.langs}, dict.fromkeys(langid.TEMPERATURES, 0.0)
    for i, t, lang in usable:
        scored = trial.entropy(t) if kept_back(i) and lang in heard else None
        if scored:
            h = scored[0]
            own = h[trial.langs.index(lang)]
            heard[lang].append(min(int(own / langid.CELL_BITS), langid.CELLS - 1))
            for heat in fits:
                fits[heat] += math.log(math.exp(-own * heat) / sum(math.exp(-x * heat) for x in h) + 1e-12)
    limits = []
    for lang in model.langs:
        cells = sorted(heard.get(lang, []))
        if not cells:
            limits.append(math.inf)
            continue
        cell = next(c for c in cells if sum(x <= c for x in cells) / len(cells) >= langid.COVER)
        own = (cell + 1) * langid.CELL_BITS
        limits.append(own + langid.MARGIN * max(math.log2(model.alphabet + 1) - own, 1.0))
    return model, max(fits, key=fits.get), limits


def brute_language(rows):
    """(lang_pred, score, rejected) of each (doc_id, text, lang) row."""
    model, heat, limits = brute_calibration(rows)
    out = []
    for _, t, _ in rows:
        scored = model.entropy(t)
        if scored is None:
            out.append(("und", 0.0, True))
            continue
        h, symbols = scored
        best = min(range(len(h)), key=lambda j: h[j])
        score = math.exp(-h[best] * heat) / sum(math.exp(-x * heat) for x in h)
        out.append((model.langs[best], score, h[best] > limits[best] + langid.SHORT / math.sqrt(symbols)))
    return out


# ---- a small corpus with planted cases


def corpus():
    """(doc_id, text, lang, source, n_chars) rows: clean texts, texts of no learned language, exact and near copies, empty ones."""
    r, rows = random.Random(11), []
    for i in range(240):
        lang = ("aa", "zz")[i % 2]
        rows.append((words(r.randrange(5, 90), i, POOLS[lang]), lang))
    strange = ["".join(r.choice("jkwvhgfd") for _ in range(6)) for _ in range(40)]
    for i in range(6):
        rows.append((words(60, 1000 + i, strange), None))
    rows += [(None, "aa"), ("", "zz"), (" \t\n", "aa"), ("12 34 !! 56", "zz")]
    for i in range(8):
        text = words(80, 2000 + i, POOLS["aa"])
        rows += [(text, "aa"), (text.replace(" ", "  ", 3), "aa"), (text, "aa"), (text.rsplit(" ", 2)[0] + " lala mama", "aa")]
    long = words(3000, 5, POOLS["zz"])
    rows += [(long, "zz"), (long + " xyxo", "zz")]
    return [(i, t, lang, None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, (t, lang) in enumerate(rows)]


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_mix(rows, quality):
    """How often each row of (doc_id, text, lang, source, n_chars) is taken."""
    size = {row[0]: len(re.findall(WORD, row[1] or "")) for row in rows}
    sources = sorted({row[3] for row in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[row[0]] for row in rows if row[3] == s) for s in sources}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        for s in full or free:
            target[s] = float(3 * total[s]) if full else level * weight[s]
            left -= target[s]
        free -= full or free
    taken = {}
    for s in sources:
        def key(row):
            u = (int(hashlib.md5(f"{row[0]}:mix".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / {1: 2.0, 0: 0.5}.get(quality.get(row[0]), 1.0), row[0]

        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        fits = []
        placed = sorted((row for row in rows if row[3] == s), key=key)
        for k, row in enumerate(placed):
            if size[row[0]] > 0 and 2 * (rest - before) >= size[row[0]]:
                fits.append(k)
            before += size[row[0]]
        for k, row in enumerate(placed):
            taken[row[0]] = epochs + (bool(fits) and k <= fits[-1]) if size[row[0]] else 0
    return taken


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 200, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_language_calibration_and_verdicts_by_definition(spark):
    rows = [row[:3] for row in corpus()]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, heat, limits = brute_calibration(rows)
    found = langid.fit(table)
    assert found.langs == model.langs == ["aa", "zz"] and found.temperature == heat and np.allclose(found.limits, limits)
    out = {x.doc_id: x for x in langid.identify(table, found).collect()}
    expected = brute_language(rows)
    assert {i for i, e in enumerate(expected) if e[2]} >= set(range(240, 250))
    for i, (lang, score, rejected) in enumerate(expected):
        assert (out[i].lang_pred, out[i].rejected) == (lang, rejected) and out[i].score == pytest.approx(score, rel=1e-6)


def test_pipeline_against_plain_python(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = corpus()
    kept = [row for row, verdict in zip(rows, brute_language([row[:3] for row in rows]), strict=True) if not verdict[2]]
    assert {row[0] for row in kept} >= set(range(240))
    first = {}
    for row in kept:
        first.setdefault(squeezed(row[1]), row)
    kept = sorted(first.values())
    component = brute_components(kept)
    kept = [row for row in kept if component[row[0]][1] == row[0]]
    labels = {i: i % 2 for i in range(0, 200, 3)}
    taken = brute_mix(kept, labels)
    text = {row[0]: row[1] for row in kept}
    assert len(kept) < len(first) < len(rows) and {0, 1} < set(taken.values())

    # Stage by stage: each decides over what the one before kept, and keeps its columns.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "mixed", "packed"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), SCHEMA)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
    assert Counter(r.doc_id for r in docs.collect()) == Counter({i: n for i, n in taken.items() if n})

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(text[i], add_special_tokens=False).ids, 1] for i, n in taken.items() if n}
    pieces = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda p: (p.sequence_id, p.offset))
    done, at, current, sequence = Counter(), 0, None, 0
    for p in pieces:
        if at == 2048:
            sequence, at = sequence + 1, 0
        assert (p.sequence_id, p.offset) == (sequence, at) and p.doc_tokens == len(ids[p.doc_id])
        assert p.start == (current[1] if current else 0) and (current is None or current[0] == p.doc_id)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        at += p.length
        current = (p.doc_id, p.start + p.length)
        if current[1] == p.doc_tokens:
            done[p.doc_id] += 1
            current = None
    assert current is None and done == Counter({i: n for i, n in taken.items() if n})
    assert sequence + 1 == -(-sum(n * len(ids[i]) for i, n in taken.items() if n) // 2048)


# ---- fingerprints, term by term


def hash64(data):
    return xxhash.xxh64_intdigest(data, seed=42)


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def brute_fingerprint(text):
    """Ioffe's consistent weighted samples of the words of a text, from the draws the operator documents."""
    bag, out = Counter(re.findall(WORD, text)), []
    for j in range(fingerprints.SAMPLES):
        best = None
        for word, n in bag.items():
            term = signed64(hash64(word.encode()))
            one, two = (hash64(struct.pack("<q", term ^ k)) for k in (2 * j, 2 * j + 1))
            r = -math.log(((one >> 32) + 0.5) / 2**32 * ((one & (2**32 - 1)) + 0.5) / 2**32)
            c = -math.log(((two >> 43) + 0.5) / 2**21 * (((two >> 22) & (2**21 - 1)) + 0.5) / 2**21)
            b = ((two & (2**22 - 1)) + 0.5) / 2**22
            t = math.floor(math.log(n) / r + b)
            value = math.floor((math.log(c) - r * (t - b + 1) + 128) * 2**23)
            mine = (value, (one ^ t) & (2**32 - 1))
            best = mine if best is None else min(best, mine)
        out.append("%08x" % (best[1] if best else 0))
    return "".join(out)


def test_fingerprints_are_those_of_a_plain_sampler(spark):
    texts = [words(random.Random(i).randrange(0, 60), i) for i in range(40)] + ["", None, "naïve 漢字 naïve naïve", words(2500, 9), "  x\ty  "]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(table).collect()}
    for i, text in enumerate(texts):
        t, following = text or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = map(brute_fingerprint, (t, edited, following))

        def alike(x, y):
            return sum(x[k : k + 8] == y[k : k + 8] for k in range(0, len(x), 8)) / fingerprints.SAMPLES

        assert (out[i].fingerprint, out[i].edited_fingerprint) == (a, b), i
        assert (out[i].near_edited, out[i].near_next) == (alike(a, b), alike(a, c))


def test_error_of_the_likeness_is_that_of_independent_samples(spark):
    """Over many pairs the estimate has no bias, and its spread is the binomial one of 32 samples."""
    texts = [words(60, i, [f"v{k}" for k in range(400)]) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    errors, spread = [], []
    for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b = Counter(t.split()), Counter(edited.split())
        exact = sum((a & b).values()) / sum((a | b).values())
        errors.append(r.near_edited - exact)
        spread.append(exact * (1 - exact) / fingerprints.SAMPLES)
    rms, expected = np.sqrt(np.mean(np.square(errors))), np.sqrt(np.mean(spread))
    assert abs(np.mean(errors)) < 4 * expected / np.sqrt(len(errors)) and 0.8 * expected < rms < 1.2 * expected
