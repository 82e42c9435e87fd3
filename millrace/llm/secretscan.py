"""Secret scans with one automaton: all rules in one pass over the bytes."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules as the contract states them. For hex the length that a match must have is part of the
#: expression: a match is a maximal run, so short ones hide no long one, and words are full of short ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
#: The rule that the method adds.
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
RULES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "private_key": PRIVATE_KEY}
BASE = ("assign", "access", "hex")
#: Bytes scanned side by side.
BLOCK_BYTES = 4 << 20


class _Nfa:
    """Thompson construction over byte sets; forward and reversed edges come from the same fragments."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def sequence(self, items, flags: int, start: int) -> int:
        for op, arg in items:
            start = self.item(op, arg, flags, start)
        return start

    def item(self, op, arg, flags: int, start: int) -> int:
        if op is sre.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                start = self.sequence(body, flags, start)
            if high is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[start] += [loop, end]
                self.empty[self.sequence(body, flags, loop)] += [loop, end]
                return end
            for _ in range(high - low):
                end = self.sequence(body, flags, start)
                self.empty[start].append(end)
                start = end
            return start
        if op is sre.BRANCH:
            end = self.state()
            for body in arg[1]:
                self.empty[self.sequence(body, flags, start)].append(end)
            return end
        if op is sre.SUBPATTERN:
            _, added, _, body = arg
            return self.sequence(body, flags | added, start)
        end = self.state()
        self.moves[start].append((self.bytes_of(op, arg, flags), end))
        return end

    @staticmethod
    def bytes_of(op, arg, flags: int) -> frozenset[int]:
        if op is sre.LITERAL:
            found = {arg}
        elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            found = set()
            for o, a in arg:
                found |= {a} if o is sre.LITERAL else set(range(a[0], a[1] + 1))
        else:
            raise ValueError(f"rules are made of literals, ranges, repeats and branches; {op} is none")
        if max(found) > 127:
            raise ValueError("rules hold ASCII characters only")
        if flags & sre.SRE_FLAG_IGNORECASE:
            found |= {ord(c) for b in found for c in (chr(b).lower(), chr(b).upper())}
        return frozenset(found)

    def reversed(self) -> _Nfa:
        back = _Nfa()
        for _ in self.empty:
            back.state()
        for s, targets in enumerate(self.empty):
            for t in targets:
                back.empty[t].append(s)
        for s, moves in enumerate(self.moves):
            for symbols, t in moves:
                back.moves[t].append((symbols, s))
        return back

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``moves[state * classes + class_of[byte]]``; bit r of ``accepts[state]`` says that a match of rule r ends here. State 0 starts."""

    class_of: np.ndarray
    classes: int
    moves: np.ndarray
    accepts: np.ndarray


def _determinize(nfa: _Nfa, starts: set[int], ends: dict[int, int], unanchored: bool) -> Dfa:
    """Subset construction over classes of bytes that no rule tells apart, then minimisation by partition refinement."""
    sets = sorted({symbols for moves in nfa.moves for symbols, _ in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    class_of = np.array([names[sig] for sig in signature])
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(names))]

    # A subset is an integer with one bit per state; what each state reaches by each class is worked out once.
    closed = [sum(1 << t for t in nfa.closure({s})) for s in range(len(nfa.empty))]
    reach = [[0] * len(names) for _ in closed]
    for s, moves in enumerate(nfa.moves):
        for symbols, t in moves:
            for c, b in enumerate(sample):
                if b in symbols:
                    reach[s][c] |= closed[t]
    first = 0
    for s in starts:
        first |= closed[s]
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        by_class = [first if unanchored else 0] * len(names)
        left = subset
        while left:
            for c, target in enumerate(reach[(left & -left).bit_length() - 1]):
                by_class[c] |= target
            left &= left - 1
        for c, target in enumerate(by_class):
            if target not in number:
                number[target] = len(order)
                order.append(target)
            by_class[c] = number[target]
        rows.append(by_class)
    moves = np.array(rows)
    accepts = np.array([sum(1 << r for r in {r for s, r in ends.items() if subset >> s & 1}) for subset in order])

    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        known: dict[bytes, int] = {}
        finer = np.array([known.setdefault(row.tobytes(), len(known)) for row in np.column_stack([block[:, None], block[moves]])])
        if finer.max() == block.max():
            break
        block = finer
    # Blocks are numbered by their first state, so the start stays 0.
    _, where = np.unique(block, return_index=True)
    rank = np.empty(len(where), np.int64)
    rank[np.argsort(where)] = np.arange(len(where))
    heads = np.sort(where)
    return Dfa(class_of.astype(np.uint8), len(names), rank[block[moves[heads]]].astype(np.int32).ravel(), accepts[heads].astype(np.int32))


class Scanner:
    """The combined automaton of all rules, which finds where matches end, and one reversed automaton per rule for where they begin."""

    def __init__(self, rules: dict[str, str]):
        self.kinds = list(rules)
        nfa, starts, ends = _Nfa(), set(), {}
        self.backward = []
        for r, pattern in enumerate(rules.values()):
            start = nfa.state()
            end = nfa.sequence(sre_parser.parse(pattern), 0, start)
            starts.add(start)
            ends[end] = r
            one = _Nfa()
            s = one.state()
            e = one.sequence(sre_parser.parse(pattern), 0, s)
            self.backward.append(_determinize(one.reversed(), {e}, {s: 0}, unanchored=False))
        self.forward = _determinize(nfa, starts, ends, unanchored=True)
        table = self.forward.moves.reshape(-1, self.forward.classes)
        #: Bytes that lead back to the start from everywhere: no match holds one, so texts can be cut at them.
        self.cuts = (table == 0).all(axis=0)[self.forward.class_of]

    def ends(self, raw: np.ndarray) -> list[np.ndarray]:
        """Per rule: the sorted places right behind the last byte of each maximal run of match ends. One pass over the bytes."""
        f = self.forward
        inside = np.flatnonzero(np.diff(np.concatenate([[True], self.cuts[raw], [True]]).astype(np.int8)))
        begins, lengths = inside[::2], inside[1::2] - inside[::2]
        by = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[by], lengths[by]
        classes = f.class_of[raw]
        state = np.zeros(len(begins), np.int32)
        places, masks = [], []
        live_at = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for step, live in enumerate(live_at):
            at = begins[:live] + step
            state = f.moves[state[:live] * f.classes + classes[at]]
            mask = f.accepts[state]
            hit = np.flatnonzero(mask)
            if len(hit):
                places.append(at[hit])
                masks.append(mask[hit])
        where = np.concatenate([*places, np.zeros(0, np.int64)])
        mask = np.concatenate([*masks, np.zeros(0, np.int32)])
        found = []
        for r in range(len(self.kinds)):
            mine = np.sort(where[mask >> r & 1 == 1])
            found.append(mine[np.append(np.diff(mine) > 1, True)] + 1 if len(mine) else mine)
        return found

    def begin(self, rule: int, raw: bytes, end: int, floor: int) -> int:
        """The leftmost begin, not before ``floor``, of a match that ends at ``end``; -1 if there is none."""
        d, state, best, at = self.backward[rule], 0, -1, end
        while at > floor:
            at -= 1
            state = int(d.moves[state * d.classes + int(d.class_of[raw[at]])])
            if d.accepts[state]:
                best = at
        return best

    def spans(self, raw: bytes, ends: Sequence[int], rule: int, low: int) -> Iterator[tuple[int, int]]:
        """Leftmost non-overlapping (begin, end) of one rule in one text, which begins at ``low``."""
        floor = low
        for end in ends:
            lead = end
            while lead > floor and not self.cuts[raw[lead - 1]]:
                lead -= 1
            begin = self.begin(rule, raw, int(end), lead)
            if begin >= 0:
                yield begin, int(end)
                floor = int(end)


_ASSIGNED = re.compile(ASSIGN.encode())


def long_enough(kind: str, match: bytes) -> bool:
    if kind == "assign":
        return len(_ASSIGNED.fullmatch(match).group(1)) >= ASSIGN_LENGTH
    return kind != "access" or len(match) >= ACCESS_LENGTH


def find_spans(scanner: Scanner, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
    """Per text: its spans (start, end, kind) in code points, by start and then in the order of the rules."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) < BLOCK_BYTES):
            size += len(parts[hi]) + 1
            hi += 1
        raw = b"\n".join(parts[lo:hi]) + b"\n"
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts[lo:hi])])
        view = np.frombuffer(raw, np.uint8)
        by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for rule, ends in enumerate(scanner.ends(view)):
            owner = np.searchsorted(bounds, ends - 1, side="right") - 1
            for i in np.unique(owner):
                for begin, end in scanner.spans(raw, ends[owner == i], rule, int(bounds[i])):
                    if long_enough(scanner.kinds[rule], raw[begin:end]):
                        by_text[int(i)].append((begin, rule, end))
        for i, found in by_text.items():
            low = int(bounds[i])
            points = np.concatenate([[0], np.cumsum((view[low : bounds[i + 1]] & 0xC0) != 0x80)])
            out[lo + i] = [(int(points[b - low]), int(points[e - low]), scanner.kinds[r]) for b, r, e in sorted(found)]
        lo = hi
    return out


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts; a null text is an empty one, without spans. Matches of one kind are leftmost and do not overlap; kinds may overlap
    each other. Repeated rows give repeated results; an empty table gives no rows. A narrow map: nothing is shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(Scanner(RULES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(sent.value, batch.column(1).to_pylist())
            base = [[s for s in spans if s[2] in BASE] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE),
                 pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                 pa.array([joined(spans) for spans in found], pa.string())],
                names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = df.select(F.col(id_col).alias("_id")).schema
    for kind in BASE:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return df.select(F.col(id_col).alias("_id"), text_col).mapInArrow(scan, schema).withColumnRenamed("_id", id_col)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, row, {i} AS pos, '{kind}' AS kind, regexp_extract_all(text, {_quoted(p)}) AS m, string_split_regex(text, {_quoted(p)}) AS p FROM d"
    for i, (kind, p) in enumerate(RULES.items()))
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents), f AS ({_FOUND}),
u AS (SELECT row, pos, kind, m, p, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (
  SELECT row, pos, kind, m[i] AS hit, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM u WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m[i], {_quoted(ASSIGN)}, 1)) >= {ASSIGN_LENGTH} WHEN 'access' THEN length(m[i]) >= {ACCESS_LENGTH} ELSE true END
), t AS (SELECT *, kind || ':' || start || ':' || (start + length(hit)) AS word FROM s),
g AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(word, ',' ORDER BY start, pos) FILTER (pos < 3), '') AS base, string_agg(word, ',' ORDER BY start, pos) AS spans
  FROM t GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""
