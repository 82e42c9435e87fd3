"""Text transforms, masks and the free-text scrub."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero_based_substring(c: Column, start: int, length: int) -> Column:
    if start < 0:
        raise ValueError("a zero-based start cannot be negative; use last_chars")
    return F.substring(c, start + 1, length)


def last_chars(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def equals_trimmed(c: Column, value: str) -> Column:
    return F.trim(c) == value.strip()


def mask_ssn(c: Column) -> Column:
    """Keep the third part of a three-part number; other text passes through."""
    parts = F.split(c, "-")
    return F.when(F.size(parts) == 3, F.concat(F.lit("XXX-XX-"), F.get(parts, F.lit(2)))).otherwise(c)


def mask_email(c: Column) -> Column:
    """Hide what stands before the ``@``; text without one passes through."""
    at = F.instr(c, "@")
    return F.when(at > 0, F.concat(F.lit("***"), F.substr(c, at))).otherwise(c)


def hex_digest(c: Column, algorithm: str) -> Column:
    if algorithm in ("sha256", "sha512"):
        return F.sha2(c, int(algorithm[3:]))
    return {"md5": F.md5, "sha1": F.sha1}[algorithm](c)


# Two-valued text pairs.
BOOLEAN_PAIRS = (("yes", "no"), ("true", "false"), ("y", "n"), ("t", "f"))


def boolean_pair(distinct: Sequence[str]) -> tuple[str, str] | None:
    """The pair that covers a column's lower-cased distinct values, if one does."""
    values = set(distinct)
    if not values or len(values) > 2:
        return None
    return next((p for p in BOOLEAN_PAIRS if values <= set(p)), None)


def to_boolean(c: Column, pair: tuple[str, str]) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text == pair[0], True).when(text == pair[1], False)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form; the one step Spark has no expression for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


# What the scrub looks for, in order, with the mask it leaves. Each rule is led by the pieces one of which a
# text must hold for the rule to be able to match, in lower case where the rule ignores case; no pieces means the rule is always tried.
_LABELS = (r"pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|"
           r"private[ _-]?key|client[ _-]?secret|credentials?|auth(?:orization)?")
_EXTENSIONS = (r"csv|tsv|xlsx?|xlsm|xlsb|parquet|json|jsonl|ndjson|txt|pdf|docx?|pptx?|sql|db|"
               r"sqlite|zip|gz|tar|pkl|pickle|feather|orc|avro|xml|ya?ml|log|ipynb|sav|dta")
# What Java takes for i and s where case does not count, besides these, in lower case.
_LOOKALIKES = ("ı", "i\u0307", "ſ")
SCRUB_RULES = (
    (("-----BEGIN",), "credential", r"(?s)-----BEGIN [A-Z ]{0,40}-----.*?(?:-----END [A-Z ]{0,40}-----|$)", "[secret]"),
    (("://",), "url", r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://\S+", "[url]"),
    (("www.",), "url", r"(?i)\bwww\.[^\s]+", "[url]"),
    (("bearer",), "credential", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=\-]{8,}", "[secret]"),
    (("pass", "pwd", "secret", "token", "key", "credential", "auth", *_LOOKALIKES), "credential", rf"(?i)\b({_LABELS})(\s*[:=]\s*|\s+is\s+)\S+", "$1 [secret]"),
    ((), "credential", r"\b(?:sk|pk|rk|gsk|ghp|gho|ghs|ghu|glpat|xox[baprs]|AIza|ya29)[-_.]?[A-Za-z0-9_\-]{12,}", "[secret]"),
    (("AKIA", "ASIA"), "credential", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,}", "[secret]"),
    (("ey",), "credential", r"\bey[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*", "[secret]"),
    (("@",), "email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", "[email]"),
    (('"', "“"), "literal", r"\"[^\"\n]{1,200}\"|[“][^”\n]{1,200}[”]", "[value]"),
    (("'", "‘"), "literal", r"(?<![A-Za-z0-9])'[^'\n]{1,200}'(?![A-Za-z0-9])|‘[^’\n]{1,200}’", "[value]"),
    ((":\\",), "file", r"\b[A-Za-z]:\\[^\s]+", "[file]"),
    (("\\\\",), "file", r"\\\\[^\s\\]+\\[^\s]+", "[file]"),
    (("/",), "file", r"(?<![\w/])(?:~|\.{1,2})?/(?:[\w.\-]+/)+[\w.\-]*", "[file]"),
    ((".",), "file", rf"(?i)[\w\-.()]+\.(?:{_EXTENSIONS})\b", "[file]"),
    (("-",), "id", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[id]"),
    ((), "number", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b", "[number]"),
    (("/", "."), "date", r"\b\d{1,4}[/.]\d{1,2}[/.]\d{2,4}\b", "[date]"),
    ((), "number", r"(?<![\w.])(?=\+?\(?(?:[\s\-.()]*\d){6})\+?\(?\d[\d\s\-.()]{4,}\d(?!\w)", "[number]"),
    ((), "credential", r"\b[0-9a-fA-F]{32,}\b", "[secret]"),
    ((), "credential", r"(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]{24,}(?![A-Za-z0-9_\-]))(?=[A-Za-z0-9_\-]*[a-z])"
                   r"(?=[A-Za-z0-9_\-]*[A-Z])(?=[A-Za-z0-9_\-]*\d)[A-Za-z0-9_\-]{24,}", "[secret]"),
)
# Parts of rules, by the rule. A match of the rule holds one of its part, which starts at a rare character, so it is found or
# ruled out at a fraction of the rule's cost; the rule is tried only on texts where it is found.
SCRUB_PARTS = {
    rf"(?i)[\w\-.()]+\.(?:{_EXTENSIONS})\b": rf"(?i)\.(?:{_EXTENSIONS})\b",
    r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b": r"[A-Z]{2}\d{2}",
    r"\b\d{1,4}[/.]\d{1,2}[/.]\d{2,4}\b": r"\d[/.]\d{1,2}[/.]\d{2}",
    r"(?<![\w.])(?=\+?\(?(?:[\s\-.()]*\d){6})\+?\(?\d[\d\s\-.()]{4,}\d(?!\w)": r"\d(?:[\s\-.()]*\d){5}",
    SCRUB_RULES[-1][2]: "[0-9]",
}
# Invisible marks that are taken out and control characters that become a space.
INVISIBLE = "[​-‏‪-‮⁠-⁤﻿­]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SCRUB_CATEGORIES = tuple(dict.fromkeys(c for _, c, _, _ in SCRUB_RULES))


def scrub(df, column: str, out: str = "cleaned", limit: int | None = None, normalise: bool = True):
    """Mask secrets, links, addresses, quoted values, paths, numbers and ids; adds ``out`` and a count per category.

    The whole text is processed. ``limit`` caps only what is kept afterwards, never inside a mask.
    """
    # ASCII text is its own normal form and has no invisible marks. Plain patterns read it exactly as Unicode-aware ones do, several times
    # faster. Masks are ASCII, so what is ASCII stays so.
    own, plain = F.col(column), F.col("_plain")
    work = df.withColumn("_plain", F.length(own) == F.octet_length(own))
    other = F.when(~plain, own)
    if normalise:
        # A step of its own, or the texts would be normalised once per use.
        work = work.withColumn("_t", nfkc(other))
        other = F.col("_t")
    work = work.withColumn("_t", F.regexp_replace(F.when(plain, own).otherwise(F.regexp_replace(other, INVISIBLE, "")), CONTROL, " "))
    work = work.withColumns({f"n_{c}": F.lit(0) for c in SCRUB_CATEGORIES})
    t = F.col("_t")
    for pieces, category, pattern, mask in SCRUB_RULES:
        done = F.when(plain, F.regexp_replace(t, pattern, mask)).otherwise(F.regexp_replace(t, "(?U)" + pattern, mask))
        if pieces:
            looked = t
            if pattern.startswith("(?i)"):
                work, looked = work.withColumn("_low", F.lower(t)), F.col("_low")
            done = F.when(reduce(or_, [looked.contains(piece) for piece in pieces]), done).otherwise(t)
        if part := SCRUB_PARTS.get(pattern):
            done = F.when(F.when(plain, F.rlike(t, F.lit(part))).otherwise(F.rlike(t, F.lit("(?U)" + part))), done).otherwise(t)
        work = work.withColumn("_n", done).drop("_low")
        hits = F.when(F.col("_n") != t, F.regexp_count(t, F.lit("(?U)" + pattern))).otherwise(0)
        work = work.withColumns({f"n_{category}": F.col(f"n_{category}") + hits, "_t": F.col("_n")}).drop("_n")
    clean = F.trim(F.when(plain, F.regexp_replace("_t", r"\s+", " ")).otherwise(F.regexp_replace("_t", r"(?U)\s+", " ")))
    if limit:
        cut = F.regexp_replace(F.rtrim(F.substring(clean, 1, limit)), r"\[[a-z]*$", "")
        clean = F.when(F.length(clean) > limit, F.concat(F.rtrim(cut), F.lit("…"))).otherwise(clean)
    return work.withColumn(out, F.when(clean != "", clean)).drop("_t", "_plain")


# The word splitter for names and the mask they leave.
NAME_WORD = r"(?U)[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+"
NAME_MASK = "[name]"
MIN_INSIDE = 4
#: Different tokens that a task remembers before it starts anew, and the longest one that it remembers.
REMEMBERED, LONG_TOKEN = 200_000, 64
#: White space as Java's (?U) has it.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _split_name(name: str) -> tuple[str, ...]:
    import regex

    return tuple(w.lower() for w in regex.findall(NAME_WORD.replace("(?U)", ""), unicodedata.normalize("NFKC", name)))


class _Token(NamedTuple):
    """What a token is by itself: its words, "a" (aligned), "i" (inside) or "-", and the ends of it, as (text, number of
    words), with which a name of several tokens may begin."""

    words: tuple[str, ...]
    kind: str
    openings: tuple[tuple[str, int], ...]


class _Tokens(dict):
    """Token -> ``_Token`` for one vocabulary; texts repeat their tokens, so each is looked at once while it is remembered."""

    def __init__(self, known: frozenset[str], longest: int):
        super().__init__()
        import regex

        self.known, self.longest = known, longest
        self.inside = [s for s in sorted(known) if len(s) >= MIN_INSIDE]
        self.beginnings = {s[:i] for s in known for i in range(1, len(s))}
        self.any_known = re.compile("|".join(map(re.escape, sorted(known)))).search
        # This library's classes are those of Java's (?U), but for letters newer than either knows; in ASCII all agree.
        words = NAME_WORD.replace("(?U)", "")
        self.ascii_words, self.words_of = re.compile(words).findall, regex.compile(words).findall
        self.head, self.tail = regex.compile(r"^[^\w\[\]]*"), regex.compile(r"[^\w\[\]]*$")

    def __missing__(self, token: str) -> _Token:
        words = tuple(w.lower() for w in (self.ascii_words if token.isascii() else self.words_of)(token))
        whole, kind = "".join(words), "-"
        # Whatever makes a token a or i is a known name among the letters of its words.
        if self.any_known(whole):
            runs = ("".join(words[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(words) - n + 1))
            if whole in self.known or any(r in self.known for r in runs):
                kind = "a"
            elif any(map(self._holds, (*words, whole))):
                kind = "i"
        ends = [("".join(words[-n:]), n) for n in range(1, min(self.longest, len(words) + 1))]
        found = _Token(words, kind, tuple(e for e in ends if e[0] in self.beginnings))
        if len(token) <= LONG_TOKEN:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found

    def _holds(self, word: str) -> bool:
        stems = (word, word.removesuffix("s"), word.removesuffix("es"))
        return any(s in self.known for s in stems) or any(s in word for s in self.inside)

    def mask(self, text: str) -> tuple[str, int, int]:
        """The text with its names masked, the aligned tokens and those with a name inside."""
        raw = _GAP.split(text.strip(" "))
        tokens = [self[r] for r in raw]
        kinds = [t.kind for t in tokens]
        for i, token in enumerate(tokens):
            for begun, n in token.openings:
                self._extend(tokens, kinds, i, begun, n)
        shown = " ".join([r if k == "-" else self.head.search(r)[0] + NAME_MASK + self.tail.search(r)[0] for r, k in zip(raw, kinds, strict=True)])
        return re.sub(r"\[name\](?:[ \t\n\x0b\f\r]+\[name\])+", NAME_MASK, shown), kinds.count("a"), kinds.count("i")

    def _extend(self, tokens: list[_Token], kinds: list[str], at: int, begun: str, n: int) -> None:
        """Mark the tokens of each name that goes on from the end ``begun`` of a token, ``n`` words, into those that follow."""
        over = [at]
        for i in range(at + 1, len(tokens)):
            for word in tokens[i].words:
                n, begun = n + 1, begun + word
                if n > self.longest:
                    return
                if over[-1] != i:
                    over.append(i)
                if begun in self.known:
                    for j in over:
                        kinds[j] = "a"
                if begun not in self.beginnings:
                    return


def strip_names(df, column: str, names: Sequence[str], out: str = "stripped"):
    """Mask every token that is, or holds, one of ``names``; adds ``out`` and ``n_aligned`` / ``n_inside``.

    The vocabulary is column and table names: a schema's worth of literals, so no join and no shuffle. A name covers
    whole words of one token ("byRegion"), several tokens ("order date" for order_date), or, from four letters on,
    the inside of a longer word. What a token is by itself depends on nothing else, so each task looks at each different
    token once; names of several tokens are followed only from tokens that end like the beginning of one.
    """
    keys = {w for n in names for part in {n, *n.split(".")} if (w := _split_name(part))}
    if not keys:
        raise ValueError("an empty vocabulary cannot protect a text")
    known, longest = frozenset("".join(k) for k in keys), max(map(len, keys))

    @F.pandas_udf("text string, aligned int, inside int")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens(known, longest)
        for texts in batches:
            yield pd.DataFrame([(None, None, None) if t is None else tokens.mask(t) for t in texts], columns=["text", "aligned", "inside"], dtype=object)

    work = df.withColumn("_r", masked(F.col(column)))
    return work.withColumns({out: F.col("_r.text"), "n_aligned": F.col("_r.aligned"), "n_inside": F.col("_r.inside")}).drop("_r")
