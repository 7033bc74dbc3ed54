"""The tag query language: text to syntax tree, tree to a Column.

    query    := selector (',' selector)*
    selector := [types | '*'] clause*
    clause   := '[' '!' key ']' | '[' key ']' | '[' key op value (',' value)* ']'

Every test compiles to a Column that is never null, before anything is negated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.tags import number

ALL = frozenset("nwar")
_OPS = ("!=", ">=", "<=", "!~", "=", ">", "<", "~")
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>!=|>=|<=|!~|=|>|<|~)|(?P<mark>[\[\]!,*])"""
    r"""|(?P<name>[^\W\d_][\w:]*)|(?P<number>-?(?:\d+\.?\d*|\.\d+))""",
    re.DOTALL,
)
_ESCAPES = {"b": "\b", "n": "\n", "t": "\t", "f": "\f", "r": "\r", "'": "'", '"': '"', "\\": "\\", "0": "\0"}


class QueryError(ValueError):
    """A query that can't be understood; says where."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        self.line, self.column = line, column
        super().__init__(message if line is None else f"[{line}:{column}]: {message}")


@dataclass(frozen=True)
class Test:
    """One comparison. kind: eq, num_eq, lt, le, gt, ge, starts, ends, contains, regex."""

    kind: str
    value: str | float
    negated: bool = False


@dataclass(frozen=True)
class Clause:
    """What is asked of one key: groups of tests, all of which must hold; of a group any (or, of negated tests, all)."""

    key: str
    required: bool
    #: present by [k] only, so that "no" is rejected too
    plain: bool
    groups: tuple[tuple[Test, ...], ...] = ()


@dataclass(frozen=True)
class Selector:
    types: frozenset[str]
    clauses: tuple[Clause, ...]


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.DOTALL)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.kind, self.value, self.start = "", "", 0
        self.next()

    def next(self) -> None:
        while True:
            self.start = self.at
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.fail(f"Unexpected character {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def fail(self, message: str):
        before = self.text[: self.start]
        raise QueryError(message, before.count("\n") + 1, self.start - (before.rfind("\n") + 1) + 1)

    def take(self, kind: str, value: str | None = None) -> str | None:
        if self.kind == kind and value in (None, self.value):
            got = self.value
            self.next()
            return got
        return None


def _wildcard(s: str, negated: bool) -> Test:
    if s.startswith("*"):
        return Test("contains", s[1:-1], negated) if s.endswith("*") else Test("ends", s[1:], negated)
    if s.endswith("*"):
        return Test("starts", s[:-1], negated)
    return Test("eq", s, negated)


def _value(r: _Reader, op: str) -> Test:
    numbers, texts = op not in ("~", "!~"), op in ("=", "!=", "~", "!~")
    negated = op in ("!=", "!~")
    if r.kind == "number" and numbers:
        n = float(r.value)
        r.next()
        return Test({"=": "num_eq", "!=": "num_eq", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}[op], n, negated)
    if r.kind in ("name", "string") and texts:
        s = _unquote(r.value) if r.kind == "string" else r.value
        r.next()
        return Test("regex", s, negated) if op in ("~", "!~") else _wildcard(s, negated)
    r.fail(f"Expected {'string or number' if numbers and texts else 'number' if numbers else 'string'} instead of {r.value or 'end'}")


def _clause(r: _Reader) -> Clause:
    absent = r.take("mark", "!") is not None
    if r.kind not in ("name", "string"):
        r.fail(f"Expected key instead of {r.value or 'end'}")
    key = _unquote(r.value) if r.kind == "string" else r.value
    r.next()
    op = None if absent else r.take("op")
    tests = []
    if op:
        tests.append(_value(r, op))
        while r.kind == "mark" and r.value == ",":
            if op in ("<", "<=", ">", ">="):
                r.fail(f"{op} takes a single value")
            r.next()
            tests.append(_value(r, op))
    if r.take("mark", "]") is None:
        r.fail(f"Expected ] instead of {r.value or 'end'}")
    return Clause(key, not absent and (op is None or op not in ("!=", "!~")), op is None and not absent, (tuple(tests),) if tests else ())


def _merge(a: Clause, b: Clause) -> Clause:
    """Two clauses of one key."""
    if not (a.required or a.groups) or not (b.required or b.groups):  # [!k] is one of them
        if a.required or b.required:
            raise QueryError(f"[!{a.key}] leaves nothing for the other tests of {a.key!r}")
        return Clause(a.key, False, False)
    # "no" is rejected if the key is only asked for by [k]
    asked = [c for c in (a, b) if c.required]
    return Clause(a.key, bool(asked), bool(asked) and all(c.plain for c in asked), a.groups + b.groups)


def _selector(r: _Reader) -> Selector:
    types = ALL
    if r.kind == "name":
        word, types = r.value, frozenset(r.value)
        for ch in word:
            if ch not in ALL:
                r.fail(f"{ch!r} is no type of feature; these are n, w, a and r")
        if len(types) != len(word):
            r.fail(f"Repeated feature type in {word!r}")
        r.next()
    elif not r.take("mark", "*") and not (r.kind == "mark" and r.value == "["):
        r.fail(f"Expected a selector instead of {r.value or 'end'}")
    clauses: dict[str, Clause] = {}
    while r.take("mark", "["):
        c = _clause(r)
        clauses[c.key] = _merge(clauses[c.key], c) if c.key in clauses else c
    return Selector(types, tuple(sorted(clauses.values(), key=lambda c: c.key)))


@lru_cache(maxsize=1024)
def parse(text: str, strict_parity: bool = False) -> tuple[Selector, ...]:
    """The selectors of a query. ``strict_parity``: selectors of different types are an error."""
    r = _Reader(text)
    out = [_selector(r)]
    while r.take("mark", ","):
        out.append(_selector(r))
    if r.kind != "end":
        r.fail(f"Expected end of query instead of {r.value}")
    if strict_parity and len({s.types for s in out}) > 1:
        raise QueryError("selectors of different types in one query")
    return tuple(out)


def types_of(selectors: tuple[Selector, ...]) -> frozenset[str]:
    return frozenset().union(*(s.types for s in selectors))


def _test(v: Column, t: Test) -> Column:
    if t.kind == "regex":  # the first match must be the whole value
        hit = (F.regexp_extract(v, t.value, 0) == v) & v.rlike(t.value)
    elif t.kind == "eq":
        hit = v == t.value
    elif t.kind in ("starts", "ends", "contains"):
        hit = {"starts": v.startswith, "ends": v.endswith, "contains": v.contains}[t.kind](t.value)
    else:
        n = number(v)
        hit = {"num_eq": n == t.value, "lt": n < t.value, "le": n <= t.value, "gt": n > t.value, "ge": n >= t.value}[t.kind]
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if t.negated else hit


def _fold(parts: list[Column], both) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = both(out, p)
    return out


def _clause_column(c: Clause, v: Column) -> Column:
    if not c.groups:
        return F.coalesce(v != "no", F.lit(False)) if c.required else F.coalesce(v == "no", F.lit(True))
    groups = [_fold([_test(v, t) for t in g], (lambda a, b: a & b) if g[0].negated else (lambda a, b: a | b)) for g in c.groups]
    holds = _fold(groups, lambda a, b: a & b)
    if not c.required:
        return v.isNull() | holds
    out = v.isNotNull() & holds
    return out & F.coalesce(v != "no", F.lit(False)) if c.plain else out


def compile_query(selectors: tuple[Selector, ...], tag: Callable[[str], Column], category: Column | None = None) -> Column:
    """A predicate over a row. ``tag`` gives the value of a key, null if absent; ``category``: n, w, a or r (None: don't ask)."""
    out = []
    for s in selectors:
        parts = [_clause_column(c, tag(c.key)) for c in s.clauses]
        if category is not None and s.types != ALL:
            parts.insert(0, category.isin(*sorted(s.types)))
        out.append(_fold(parts, lambda a, b: a & b) if parts else F.lit(True))
    return _fold(out, lambda a, b: a | b)
