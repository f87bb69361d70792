"""The Boolean query language: string to postfix to a condition on per-term flags.

``compat`` keeps the quirks of the established behaviour: operators are found anywhere in
the text, also inside words; an operand's words are glued together; implicit AND only in
queries without an operator word; what is left below the bottom of the stack is ignored.
``strict`` has word boundaries, implicit AND between neighbours, ``x NOT y`` for
``x AND NOT y``, and errors for unbalanced parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.analysis import Analyzer

BINDING = {"OR": 1, "AND": 2, "NOT": 3}
_ANYWHERE = re.compile(r"(AND|OR|NOT|\(|\))", re.IGNORECASE)
_WORDS = re.compile(r"[()]|[^\s()]+")


class QuerySyntaxError(ValueError):
    """A query whose operators lack operands, or, in strict mode, with unbalanced parentheses."""


@dataclass(frozen=True)
class Expr:
    """``op`` is TERM, AND, OR or NOT; a TERM has its ``term``, the others their arguments."""

    op: str
    args: tuple["Expr", ...] = ()
    term: str = ""

    def condition(self, flag) -> Column:
        """A Column, given ``flag(term)``; Catalyst simplifies it."""
        if self.op == "TERM":
            return flag(self.term)
        sides = [a.condition(flag) for a in self.args]
        return {"AND": lambda: sides[0] & sides[1], "OR": lambda: sides[0] | sides[1], "NOT": lambda: ~sides[0]}[self.op]()

    def holds(self, present: set[str]) -> bool:
        if self.op == "TERM":
            return self.term in present
        sides = [a.holds(present) for a in self.args]
        return not sides[0] if self.op == "NOT" else all(sides) if self.op == "AND" else any(sides)

    def terms(self) -> set[str]:
        return {self.term} if self.op == "TERM" else set().union(*(a.terms() for a in self.args))


@dataclass(frozen=True)
class Query:
    postfix: tuple[str, ...]
    matches: Expr | None  # None: nothing matches
    bag: tuple[str, ...]  # all operands, negated and repeated ones, too

    @property
    def needs_universe(self) -> bool:
        """Whether documents without any of the terms match."""
        return self.matches is not None and self.matches.holds(set())


def _tokens(text: str, analyzer: Analyzer, mode: str) -> list[str]:
    if mode == "compat":
        words = text.split()
        if len(words) > 1 and not any(w.upper() in BINDING for w in words):
            text = " AND ".join(words)
        parts = [p.strip() for p in _ANYWHERE.split(text)]
    else:
        parts = _WORDS.findall(text)
    marks = (*BINDING, "(", ")")
    found = [p.upper() if p.upper() in marks else analyzer.query_term(p) for p in parts if p]
    return [t for t in found if t]


def _with_implicit_and(tokens: list[str]) -> list[str]:
    out: list[str] = []
    for t in tokens:
        ends = bool(out) and out[-1] not in (*BINDING, "(")
        if ends and (t not in (*BINDING, ")") or t == "NOT"):
            out.append("AND")
        out.append(t)
    return out


def to_postfix(tokens: list[str], strict: bool = False) -> list[str]:
    """Precedence NOT, AND, OR; AND and OR group from the left, NOT from the right."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
            elif strict:
                raise QuerySyntaxError("a ) without its (")
        elif t in BINDING:
            # What binds as tightly goes first, except before the right-grouping NOT.
            least = BINDING[t] + (t == "NOT")
            while held and BINDING.get(held[-1], 0) >= least:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    if strict and "(" in held:
        raise QuerySyntaxError("a ( without its )")
    return out + held[::-1]


def parse(text: str, analyzer: Analyzer, mode: str = "compat") -> Query:
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode {mode}")
    tokens = _tokens(text, analyzer, mode)
    strict = mode == "strict"
    postfix = to_postfix(_with_implicit_and(tokens) if strict else tokens, strict)
    stack: list[Expr] = []
    bag: list[str] = []
    for t in postfix:
        if t in BINDING:
            n = 1 if t == "NOT" else 2
            if len(stack) < n:
                raise QuerySyntaxError(f"{t} lacks an operand in {text!r}")
            args = tuple(stack[-n:])
            del stack[-n:]
            stack.append(Expr(t, args))
        else:
            bag.append(t)
            stack.append(Expr("TERM", term=t))
    if strict and len(stack) > 1:
        raise QuerySyntaxError(f"operands without an operator in {text!r}")
    return Query(tuple(postfix), stack[0] if stack else None, tuple(bag))


def any_of(terms: list[str]) -> Query:
    """The disjunction of terms, as the validator searches."""
    leaves = [Expr("TERM", term=t) for t in dict.fromkeys(terms)]
    return Query(tuple(terms), reduce(lambda a, b: Expr("OR", (a, b)), leaves) if leaves else None, tuple(terms))


def set_form(expr: Expr, postings, universe):
    """The same matches by INTERSECT, UNION and EXCEPT of doc_id sets; to verify the flag form."""
    if expr.op == "TERM":
        return postings.where(F.col("term") == expr.term).select("doc_id")
    sides = [set_form(a, postings, universe) for a in expr.args]
    if expr.op == "NOT":
        return universe.subtract(sides[0])
    return sides[0].intersect(sides[1]) if expr.op == "AND" else sides[0].union(sides[1]).distinct()
