"""Patterns written as text.

    { [ [VAL#'line' : 'LINE'->AVP] [BLANK ? SKIP] ]
      [ [VAL : 'STOP'->AVP] [VAL : 'TIME'->AVP, (LT, ST&#'line')->REC] ]+ }+

Reads the text into the values of `spec`.  Keywords don't mind case; actions written before
the content of a table, subtable, row, subrow or cell are inherited by all its atoms.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import product

from gridweave.plans import spec as S
from gridweave.plans.spec import PatternError, Whole

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\r\n﻿]+|//[^\r\n]*)|(?P<string>"(?:`['"]|""|[^"])*"|'(?:`['"]|''|[^'])*'|“(?:`['"]|[^”″])*[”″])"""
    r"""|(?P<frag>\$[A-Za-z][A-Za-z0-9_]*)|(?P<int>[0-9]+)|(?P<word>[A-Za-z]+|_)|(?P<mark>->|\.\.|[\[\]{}()<>?*+|&!~#@=:,.^-])"""
)
_KINDS = {"VAL": S.VAL, "ATTR": S.ATTR, "AUX": S.AUX, "SKIP": S.SKIP, "_": S.SKIP}
_STEPS = ("SUBSTR", "REPL", "NORM", "UC", "LC", "TRIM")


@dataclass(frozen=True)
class Bindings:
    """Functions for EXT('name'): tests of cells, and tests of an anchor and a candidate."""

    cells: dict[str, Callable] = field(default_factory=dict)
    pairs: dict[str, Callable] = field(default_factory=dict)
    columnar: frozenset[str] = frozenset()

    def cell(self, name: str, call: Callable, columnar: bool = False, whole: bool = False) -> Bindings:
        """A test of a cell's text; if columnar, of the Column of the texts, with `whole` of that of the cells, structs with formatting."""
        if whole:
            call, columnar = Whole(call), True
        return replace(self, cells=self._with(self.cells, name, call), columnar=self.columnar | ({name} if columnar else set()))

    def pair(self, name: str, call: Callable, columnar: bool = False) -> Bindings:
        return replace(self, pairs=self._with(self.pairs, name, call), columnar=self.columnar | ({name} if columnar else set()))

    @staticmethod
    def _with(known: dict[str, Callable], name: str, call: Callable) -> dict[str, Callable]:
        if not name.strip():
            raise ValueError("a name isn't blank")
        if name in known:
            raise ValueError(f"{name!r} is bound already")
        return {**known, name: call}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at]!r}", *_where(text, at))
        kind, value = m.lastgroup, m[0]
        if kind == "string":
            quote, value = value[0], value[1:-1]
            value = value if quote == "“" else value.replace(quote * 2, quote)
        elif kind == "word":
            value = value.upper()
        if kind != "blank":
            out.append((kind, value, at))
        at = m.end()
    return [*out, ("end", "", len(text))]


def _where(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at) - 1


class _No(Exception):
    """This alternative doesn't fit here."""


class _Reader:
    def __init__(self, text: str, bindings: Bindings | None, permissive: bool):
        self.text, self.tokens, self.i, self.far = text, _tokens(text), 0, 0
        self.bindings, self.permissive = bindings or Bindings(), permissive
        self.fragments: dict[tuple[str, str], tuple[int, int]] = {}

    # -- tokens

    def sees(self, *values: str, ahead: int = 0) -> bool:
        kind, value, _ = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return kind in ("mark", "word") and value in values

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)][0]

    def next(self) -> str:
        self.i += 1
        self.far = max(self.far, self.i)
        return self.tokens[self.i - 1][1]

    def takes(self, *values: str) -> str | None:
        return self.next() if self.sees(*values) else None

    def needs(self, *values: str) -> str:
        if not self.sees(*values):
            raise _No
        return self.next()

    def needs_kind(self, kind: str) -> str:
        if self.kind() != kind:
            raise _No
        return self.next()

    def number(self) -> int:
        return int(self.needs_kind("int"))

    def tries(self, rule: Callable, *args):
        """The rule's value, or None with nothing read."""
        start = self.i
        try:
            return rule(*args)
        except _No:
            self.i = start
            return None

    def error(self, message: str) -> PatternError:
        return PatternError(message, *_where(self.text, self.tokens[min(self.far, len(self.tokens) - 1)][2]))

    # -- structure

    def table(self) -> S.Table:
        while self.kind() == "frag":
            self.fragment()
        guard = self.tries(self.guard)
        settings = self.settings() if self.takes("<") else ()
        inherited = self.tries(self.leading_actions) or ()
        subtables = []
        while self.kind() != "end":
            subtables.append(self.subtable(inherited))
        if not subtables:
            raise _No
        return S.with_inline_settings(S.Table(tuple(subtables), guard, settings))

    def fragment(self) -> None:
        """`$N=[..]` or `$N={..}`: remembered by bracket, read where it is used."""
        name = self.next()
        self.needs("=")
        bracket = self.needs("[", "{")
        start, depth = self.i, 1
        while depth:
            if self.kind() == "end":
                raise _No
            depth += self.sees("[", "{") - self.sees("]", "}")
            self.next()
        self.fragments[name, bracket] = (start, self.i - 1)

    def inside(self, bracket: str, rule: Callable, *args):
        """Read a fragment's body where it is referred to: `[$N]` or `{$N}`."""
        name = self.next()
        self.needs("]" if bracket == "[" else "}")
        if (name, bracket) not in self.fragments:
            raise self.error(f"unknown fragment {name}")
        back, (self.i, end) = self.i, self.fragments[name, bracket]
        body = rule(*args)
        if self.i != end:
            raise _No
        self.i = back
        return body

    def settings(self) -> tuple[tuple, ...]:
        out = []
        while True:
            name = self.needs("NORM", "ANCH", "SPLIT")
            if name == "NORM":
                out.append((name,))
            else:
                self.needs("(")
                out.append((name, self.number() if name == "ANCH" else self.needs_kind("string")))
                self.needs(")")
            if not self.takes(","):
                self.needs(">")
                return tuple(out)

    def guard(self) -> S.Test:
        test = self.test()
        self.needs("?")
        return test

    def leading_actions(self) -> tuple[S.Action, ...]:
        found = self.actions(True)
        if not self.sees("[", "{"):
            raise _No
        return found

    def quantifier(self) -> S.Quantifier:
        if mark := self.takes("?", "*", "+"):
            return {"?": S.OPTIONAL, "*": S.ANY, "+": S.SOME}[mark]
        if self.sees("{") and self.kind(1) == "int" and self.sees("}", ahead=2):
            self.next()
            n = self.number()
            self.next()
            return S.exactly(n)
        return S.ONE

    def subtable(self, inherited) -> S.Subtable:
        if self.sees("{"):
            self.next()
            if self.kind() == "frag":
                body = self.inside("{", self.subtable_body, inherited)
            else:
                body = self.subtable_body(inherited)
                self.needs("}")
            return replace(body, times=self.quantifier())
        return S.Subtable(self.many(self.row, "[", inherited))

    def subtable_body(self, inherited) -> S.Subtable:
        guard = self.tries(self.guard)
        own = inherited + (self.tries(self.leading_actions) or ())
        return S.Subtable(self.many(self.row, "[", own), guard)

    def many(self, rule: Callable, bracket: str, inherited) -> tuple:
        out = [rule(inherited)]
        while self.sees(bracket):
            out.append(rule(inherited))
        return tuple(out)

    def row(self, inherited) -> S.Row:
        self.needs("[")
        if self.kind() == "frag":
            body = self.inside("[", self.row_body, inherited)
        else:
            body = self.row_body(inherited)
            self.needs("]")
        return replace(body, times=self.quantifier())

    def row_body(self, inherited) -> S.Row:
        guard = self.tries(self.guard)
        own = inherited + (self.tries(self.leading_actions) or ())
        subrows = []
        while self.sees("[", "{"):
            subrows.append(self.subrow(own) if self.sees("{") else S.Subrow(self.many(self.cell, "[", own)))
        if not subrows:
            raise _No
        return S.Row(tuple(subrows), guard)

    def subrow(self, inherited) -> S.Subrow:
        self.needs("{")
        if self.kind() == "frag":
            body = self.inside("{", self.subrow_body, inherited)
        else:
            body = self.subrow_body(inherited)
            self.needs("}")
        return replace(body, times=self.quantifier())

    def subrow_body(self, inherited) -> S.Subrow:
        guard = self.tries(self.guard)
        own = inherited + (self.tries(self.leading_actions) or ())
        return S.Subrow(self.many(self.cell, "[", own), guard)

    def cell(self, inherited) -> S.Cell:
        self.needs("[")
        if self.kind() == "frag":
            body = self.inside("[", self.cell_body, inherited)
        else:
            body = self.cell_body(inherited)
            self.needs("]")
        return replace(body, times=self.quantifier())

    def cell_body(self, inherited) -> S.Cell:
        if self.sees("]"):
            return S.Cell()
        for rule in (self.guarded_cell, self.tested_cell, self.plain_cell):
            if found := self.tries(rule, inherited):
                return found
        raise _No

    def guarded_cell(self, inherited) -> S.Cell:
        guard = self.guard()
        return replace(self.plain_cell(inherited), guard=guard)

    def tested_cell(self, inherited) -> S.Cell:
        found = S.Cell(guard=self.test())
        self.follower("]")
        return found

    def plain_cell(self, inherited) -> S.Cell:
        own = self.tries(self.content_actions) or ()
        content = self.content(inherited + own, "]")
        skipped = isinstance(content, S.Atom) and content.kind == S.SKIP
        return S.Cell(None if skipped else content)

    def content_actions(self) -> tuple[S.Action, ...]:
        found = self.actions(True)
        if not (self.sees("VAL", "ATTR", "AUX", "SKIP", "_", "(", "BLANK", "!", "~", "EXT") or self.kind() == "string"):
            raise _No
        return found

    def follower(self, *marks: str) -> None:
        if not self.sees(*marks):
            raise _No

    # -- contents

    def content(self, inherited, *ends: str) -> S.Content:
        for rule in (self.atom, self.delimited, self.compound, self.conditional):
            if (found := self.tries(self.ended, rule, inherited, ends)) is not None:
                return found
        raise _No

    def ended(self, rule, inherited, ends):
        found = rule(inherited)
        self.follower(*ends)
        return found

    def atom(self, inherited) -> S.Atom:
        kind = _KINDS[self.needs(*_KINDS)]
        tags, extract, own = [], [], ()
        while self.takes("#"):
            tags.append("#" + self.needs_kind("string"))
        if self.takes("="):
            extract.append(self.step())
            while self.takes("."):
                extract.append(self.step())
        if self.takes(":"):
            own = self.actions(False)
        return S.Atom(kind, tuple(tags), tuple(extract), inherited + own)

    def step(self) -> tuple:
        name = self.needs(*_STEPS)
        if name == "SUBSTR":
            self.needs("(")
            first = self.number()
            self.needs(",")
            step = (name, first, first + self.number())
            self.needs(")")
            return step
        if name == "REPL":
            self.needs("(")
            what = self.needs_kind("string")
            self.needs(",")
            step = (name, what, self.needs_kind("string"))
            self.needs(")")
            return step
        return (name,)

    def delimited(self, inherited) -> S.Delimited:
        self.needs("(")
        atom = self.atom(inherited)
        self.needs(")")
        self.needs("{")
        by = self.needs_kind("string")
        self.needs("}")
        return S.Delimited(atom, by)

    def segment(self, inherited) -> S.Atom | S.Delimited:
        return self.delimited(inherited) if self.sees("(") else self.atom(inherited)

    def compound(self, inherited) -> S.Compound:
        lead = self.next() if self.kind() == "string" else None
        segments = [(lead, self.segment(inherited))]
        close = None
        while self.kind() == "string":
            mark = self.next()
            following = self.tries(self.segment, inherited)
            if following is None:
                close = mark
                break
            segments.append((mark, following))
        if len(segments) == 1 and lead is None and close is None:
            raise _No
        return S.Compound(tuple(segments), close)

    def conditional(self, inherited) -> S.Conditional:
        test = self.guard()
        then = self.branch(inherited, "|")
        self.needs("|")
        return S.Conditional(test, then, self.branch(inherited, "]"))

    def branch(self, inherited, end: str) -> S.Content:
        for rule in (self.atom, self.delimited, self.compound):
            if (found := self.tries(self.ended, rule, inherited, (end,))) is not None:
                return found
        raise _No

    # -- tests and terms

    def test(self) -> S.Test:
        """A test of a cell."""
        if self.takes("EXT"):
            return self.external(self.bindings.cells, self.bindings.pairs, lambda name, call: S.Test("ext", name, call=call, columnar=name in self.bindings.columnar))
        negated = self.takes("!") is not None
        if self.takes("BLANK"):
            return S.Test("blank", negated=negated)
        if self.takes("~"):
            return S.Test("contains", self.needs_kind("string"), negated)
        return S.Test("regex", self.needs_kind("string"), negated)

    def external(self, known, others, make):
        self.needs("(")
        name = self.needs_kind("string")
        self.needs(")")
        if not name.strip():
            raise self.error("EXT needs a name")
        if name in known:
            return make(name, known[name])
        if self.permissive:
            return make(name, _always)
        raise self.error(f"EXT({name!r}) isn't bound" + " for this use" * (name in others))

    def term(self) -> S.Condition:
        """One term, or a condition in parentheses."""
        if self.takes("("):
            found = self.condition()
            self.needs(")")
            return found
        if self.takes("EXT"):
            return ((self.external(self.bindings.pairs, self.bindings.cells, lambda name, call: S.PairTest(name, call, name in self.bindings.columnar)),),)
        if self.takes("STR"):
            return ((S.SameText(),),)
        if self.sees(*S.SPATIAL, "C", "R", "P"):
            return ((self.spatial(),),)
        negated = self.takes("!") is not None
        if self.takes("#"):
            return ((S.Test("tag", "#" + self.needs_kind("string"), negated),),)
        if negated:
            self.i -= 1
        return ((self.test(),),)

    def spatial(self) -> S.Term:
        if name := self.takes(*S.SPATIAL):
            return S.Spatial(name)
        axis = self.needs("C", "R", "P")
        low, relative = self.bound()
        if not self.takes(".."):
            return S.Place(axis, low, None, relative)
        high = self.bound()[0] if self.kind() == "int" or self.sees("+", "-") and self.kind(1) == "int" else S.NO_END
        if axis == "R" and relative:
            return S.Place(axis, low, None, True)
        return S.Place(axis, low, high, relative and axis == "C")

    def bound(self) -> tuple[int, bool]:
        sign = self.takes("+", "-")
        n = self.number()
        return (-n if sign == "-" else n), sign is not None

    def condition(self) -> S.Condition:
        out = self.conjunction(self.term())
        while self.takes("|"):
            out += self.conjunction(self.term())
        return out

    def conjunction(self, first: S.Condition) -> S.Condition:
        parts = [first]
        while self.takes("&"):
            parts.append(self.term())
        return tuple(sum(chosen, ()) for chosen in product(*parts))

    # -- actions

    def actions(self, inherited: bool) -> tuple[S.Action, ...]:
        out = [self.action(inherited)]
        while self.sees(","):
            comma = self.i
            self.next()
            more = self.tries(self.action, inherited)
            if more is None:
                self.i = comma
                break
            out.append(more)
        return tuple(out)

    def action(self, inherited: bool) -> S.Action:
        providers = self.tries(self.one_provider)
        if providers is None:
            self.needs("(")
            listed = []
            while not self.takes(")"):
                if listed:
                    self.needs(",")
                listed.append(self.provider())
            self.needs("->")
            providers = tuple(listed)
        op = self.needs("FILL", "PREFIX", "SUFFIX", "AVP", "REC", "JOIN")
        extra = {}
        if op in ("FILL", "PREFIX", "SUFFIX", "REC", "JOIN") and self.takes("("):
            if op == "JOIN":
                drop = [self.number()]
                while self.takes(","):
                    drop.append(self.number())
                extra = {"drop": tuple(drop)}
            elif op == "REC":
                extra = {"at": self.number()} if self.kind() == "int" else {"split": self.needs_kind("string")}
            else:
                extra = {"text": self.needs_kind("string")}
            self.needs(")")
        try:
            return S.Action(op, providers, inherited=inherited, **extra)
        except PatternError as e:
            raise self.error(str(e)) from None

    def one_provider(self) -> tuple[S.Provider, ...]:
        found = (self.provider(),)
        self.needs("->")
        return found

    def provider(self) -> S.Provider:
        if self.takes("@"):
            attr = self.needs_kind("string")
            self.needs("=")
            return S.Pair(attr, self.needs_kind("string"))
        if self.kind() == "string":
            return S.Literal(self.next())
        order = "-" if self.takes("-") else ""
        order += "^" if self.takes("^") else ""
        if self.takes("("):
            condition = self.condition()
            self.needs(")")
        else:
            condition = self.conjunction(((self.spatial(),),))
        most: int | None = 1
        if self.takes("*"):
            most = S.UNBOUNDED
        elif self.sees("{") and self.kind(1) == "int" and self.sees("}", ahead=2):
            self.next()
            most = self.number()
            self.next()
        return S.Lookup(condition, most, order)


def _always(*_args) -> bool:
    return True


def compile_pattern(text: str, bindings: Bindings | None = None, permissive: bool = False) -> S.Table:
    """The pattern that a text describes; PatternError with line and column if it describes none.

    permissive: names of EXT that aren't bound hold always.
    """
    reader = _Reader(text, bindings, permissive)
    try:
        return reader.table()
    except _No:
        kind, value, _ = reader.tokens[min(reader.far, len(reader.tokens) - 1)]
        raise reader.error(f"unexpected {'end' if kind == 'end' else repr(value)}") from None
