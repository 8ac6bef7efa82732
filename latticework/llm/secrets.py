"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are parsed, compiled to one nondeterministic automaton over bytes, made deterministic by
subset construction and minimised. The automaton reads the reversed rules, so one backward pass over a text's bytes
finds every place where a match of any rule may start. From those places only, the rule's own automaton, compiled in the
same way, reads on to the match's longest end. States that led to no match are remembered by place, so a place
is not read again in the same state, and the work is linear in the text. Counts such as {16,} of several rules would multiply the states of the
combined automaton, so it reads them as + unless a rule is marked ``counted``; the rule's own automaton counts.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``keep``: an exact check of a matched text; what it refuses is dropped after it has consumed its place.

    ``tail``: what a match goes on with, if it is there; only the rule's own automaton reads it.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    keep: str = ""
    counted: bool = False
    tail: str = ""


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, r"""(?is)^[a-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    # a run too short to keep holds no start of a longer one, so the least length can be part of the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}", counted=True),
)
_GAP = r"""([\x09\x0a\x0d\x20>"]|\\[nr])"""
_LINE = r"[A-Za-z0-9+/]{16,}={0,2}"
#: A key up to its END line, which two dashes cannot come before; without one, headers and base64 lines, the last of any length.
_KEY = (
    r"""((-?[\x09\x0a\x0d\x20A-Za-z0-9+/=:,\\"'>])*-----END ([A-Z]+ )*PRIVATE KEY-----"""
    rf"|{_GAP}*([A-Za-z]+-[A-Za-z]+:[\x20-\x5b\x5d-\x7e]*{_GAP}+)*{_LINE}({_GAP}+{_LINE})*({_GAP}+[A-Za-z0-9+/]+=?=?)?)?"
)
#: Kinds that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", tail=_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
#: More states than this mean rules whose counts multiply.
MOST_STATES = 20_000


@dataclass
class Nfa:
    """States are numbers; ``empty`` and ``steps`` lead from one to others, the latter by a set of bytes."""

    empty: list[list[int]] = field(default_factory=list)
    steps: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1


class Pattern:
    """Parser of ASCII patterns: literals, escapes, classes, groups, alternatives, and the counts ? * + {m} {m,} {m,n}."""

    def __init__(self, text: str, ignore_case: bool):
        self.text, self.at, self.fold = text, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        return ("or", found) if len(found) > 1 else found[0]

    def sequence(self):
        found = []
        while self.peek() and self.peek() not in "|)":
            found.append(self.counted(self.atom()))
        return ("seq", found)

    def counted(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.at += 1
            return ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        if m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
            self.at = m.end()
            low = int(m[1])
            return ("rep", node, low, (int(m[3]) if m[3] else None) if m[2] else low)
        return node

    def escaped(self) -> int:
        """The byte of an escape; ``at`` is behind the backslash."""
        if self.peek() == "x":
            self.at += 3
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 1
        return ord(self.text[self.at - 1])

    def byte(self) -> int:
        self.at += 1
        return self.escaped() if self.text[self.at - 1] == "\\" else ord(self.text[self.at - 1])

    def atom(self):
        if self.peek() == "(":
            self.at += 1
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.at += 1
            return inner
        if self.peek() != "[":
            return ("set", self.folded({self.byte()}))
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            first = last = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                last = self.byte()
            found |= set(range(first, last + 1))
        self.at += 1
        return ("set", self.folded(found))

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = {ord(y) for x in found for y in (chr(x).lower(), chr(x).upper())}
        return frozenset(found)


def build(nfa: Nfa, tree, start: int, backward: bool, counted: bool = True) -> int:
    """Adds ``tree`` behind ``start``, reversed if ``backward``, with counts over 1 read as + unless ``counted``; returns its end."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.steps[start].append((tree[1], end))
        return end
    if kind == "seq":
        for part in reversed(tree[1]) if backward else tree[1]:
            start = build(nfa, part, start, backward, counted)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            nfa.empty[build(nfa, part, start, backward, counted)].append(end)
        return end
    _, part, low, high = tree
    if not counted and low > 1:
        low, high = 1, None
    for _ in range(low):
        start = build(nfa, part, start, backward, counted)
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[build(nfa, part, loop, backward, counted)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(high - low):
        start = build(nfa, part, start, backward, counted)
        nfa.empty[start].append(end)
    return end


@dataclass
class Dfa:
    """``table``: 256 next states a state, in one list, states as multiples of 256. ``accepts``: mask of rules by state."""

    table: list[int]
    accepts: list[int]
    start: int
    #: Made when first needed: the table with accepting states last, see ``accepting_last``, and the state that nothing leaves.
    ordered: tuple[list[int], int, list[int]] | None = None
    dead: int | None = None


def determinise(nfa: Nfa, first: list[int], ends: dict[int, int], floating: bool) -> Dfa:
    """Subset construction over classes of bytes that no step tells apart. ``floating``: a match may begin anywhere."""
    sets = {s for steps in nfa.steps for s, _ in steps}
    by_use: dict[tuple, list[int]] = {}
    ordered = sorted(sets, key=sorted)
    for b in range(256):
        by_use.setdefault(tuple(b in s for s in ordered), []).append(b)
    classes = list(by_use.values())

    def closed(states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    begin = closed(set(first))
    number, todo, rows, accepts = {begin: 0}, deque([begin]), [], []
    while todo:
        now = todo.popleft()
        accepts.append(sum({1 << r for s, r in ends.items() if s in now}))
        row = []
        for c in classes:
            to = closed({t for s in now for on, t in nfa.steps[s] if c[0] in on} | (set(first) if floating else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
                if len(number) > MOST_STATES:
                    raise ValueError("the rules' counts multiply to too many states")
            row.append(number[to])
        rows.append(row)
    return minimised(rows, accepts, classes)


def minimised(rows: list[list[int]], accepts: list[int], classes: list[list[int]]) -> Dfa:
    """Splits groups of states until all states of a group lead to the same groups."""
    group = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    of = [group[a] for a in accepts]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((of[s], *(of[t] for t in rows[s])), len(seen)) for s in range(len(rows))]
        if len(seen) == len(set(of)):
            break
        of = new
    table, masks = [0] * (256 * len(set(of))), [0] * len(set(of))
    for s, row in enumerate(rows):
        masks[of[s]] = accepts[s]
        for c, t in zip(classes, row):
            for b in c:
                table[of[s] * 256 + b] = of[t] * 256
    return Dfa(table, masks, of[0] * 256)


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, tuple[Dfa, ...]]:
    """The combined automaton of the reversed rules, and each rule's own forward one."""
    trees = [Pattern(r.pattern, r.ignore_case).parse() for r in rules]
    nfa = Nfa()
    first, ends = [], {}
    for i, tree in enumerate(trees):
        first.append(nfa.state())
        ends[build(nfa, tree, first[-1], True, rules[i].counted)] = i
    own = []
    for r in rules:
        tree = Pattern(r.pattern + r.tail, r.ignore_case).parse()
        one = Nfa()
        begin = one.state()
        end = build(one, tree, begin, False)
        own.append(determinise(one, [begin], {end: 0}, False))
    return determinise(nfa, first, ends, True), tuple(own)


def starts_in(data: bytes, dfa: Dfa) -> tuple[array, array]:
    """Places from which rules match and the states there, from the last place to the first: one pass over the bytes.

    The states are those of ``accepting_last``, whose table is renumbered so that accepting states come last; the inner loop
    then tests one comparison a byte. A text may hold a start every few bytes, so both are arrays of machine integers.
    """
    table, limit, _ = accepting_last(dfa)
    state, places, states, at = table[-1], array("q"), array("H"), len(data)
    for b in reversed(data):
        at -= 1
        state = table[state + b]
        if state >= limit:
            places.append(at)
            states.append(state >> 8)
    return places, states


def accepting_last(dfa: Dfa) -> tuple[list[int], int, list[int]]:
    if dfa.ordered is None:
        n = len(dfa.accepts)
        order = sorted(range(n), key=lambda s: dfa.accepts[s] != 0)
        to = {s: i for i, s in enumerate(order)}
        table = [0] * (256 * n)
        for s in range(n):
            table[to[s] * 256 : to[s] * 256 + 256] = [to[t >> 8] * 256 for t in dfa.table[s * 256 : s * 256 + 256]]
        limit = 256 * sum(a == 0 for a in dfa.accepts)
        dfa.ordered = (table + [to[dfa.start >> 8] * 256], limit, [dfa.accepts[s] for s in order])
    return dfa.ordered


class Barren:
    """For each place of a text, a state from which reading on met no further end: two bytes a place, from the first place on that any has."""

    __slots__ = ("size", "first", "states")

    def __init__(self, size: int):
        self.size, self.first, self.states = size, 0, None

    def put(self, at: int, states: array) -> None:
        """``states``, as numbers from 1, at the places from ``at`` on. Calls come with rising starts, so nothing before the first is asked for again."""
        if self.states is None:
            self.first, self.states = at, array("H", [0]) * (self.size - at)
        self.states[at - self.first : at - self.first + len(states)] = states


def longest(data: bytes, at: int, dfa: Dfa, barren: Barren | None = None) -> int:
    """End of the longest match from ``at``; -1 if there is none.

    ``barren``: by place, a state from which an earlier call read on and met no further end; this call's are added.
    """
    state, end, table, accepts = dfa.start, -1, dfa.table, dfa.accepts
    dead = dead_state(dfa)
    seen = array("H")
    known, first = (None, 0) if barren is None else (barren.states, barren.first)
    for i in range(at, len(data)):
        state = table[state + data[i]]
        if accepts[state >> 8]:
            end = i + 1
            if seen:
                del seen[:]
        elif state == dead or known and known[i - first] == (state >> 8) + 1:
            break
        else:
            seen.append((state >> 8) + 1)
    if barren is not None and seen:
        barren.put(at if end < 0 else end, seen)
    return end


def dead_state(dfa: Dfa) -> int:
    """The state that nothing leaves and that does not accept; -1 if there is none."""
    if dfa.dead is None:
        closed = (s * 256 for s, a in enumerate(dfa.accepts) if not a and all(t == s * 256 for t in dfa.table[s * 256 : s * 256 + 256]))
        dfa.dead = next(closed, -1)
    return dfa.dead


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed: each rule's leftmost matches that do not overlap.

    Null and empty texts have none.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    scan, own = compiled(rules)
    behind = [0] * len(rules)
    places, states = starts_in(data, scan)
    if not places:
        return []
    barren = [Barren(len(data)) for _ in rules]
    spans: list[tuple[int, int, int]] = []
    masks = accepting_last(scan)[2]
    for at, state in zip(reversed(places), reversed(states)):
        mask = masks[state]
        for i in range(len(rules)):
            if mask >> i & 1 and at >= behind[i]:
                end = longest(data, at, own[i], barren[i])
                if end < 0:
                    continue
                behind[i] = end
                if not rules[i].keep or re.search(rules[i].keep, data[at:end].decode("ascii")):
                    spans.append((at, i, end))
    if not text.isascii() and spans:
        spans = [(len(data[:a].decode("utf-8", "surrogatepass")), i, len(data[:e].decode("utf-8", "surrogatepass"))) for a, i, e in spans]
    return [(rules[i].kind, a, e) for a, i, e in sorted(spans)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end), for every row, in order of start and then of kind as listed.

    Null and empty texts have none. Whole texts are read. Repeated rows give equal results, an empty table an empty one; null
    doc_ids are kept, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in common.text_batches(batches):
            found = [[{"kind": k, "start": a, "end": e} for k, a, e in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from spans that the operator found; nothing here leaves the JVM."""
    names = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(names))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret's place in the text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text or not (spans := find(text)):
            return text
        out, behind = [], 0
        for _, a, e in spans:
            if a >= behind:
                out += [text[behind:a], mark]
            behind = max(behind, e)
        return "".join(out) + text[behind:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.text_batches(batches):
            new = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, batch.schema.names[at], new)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
