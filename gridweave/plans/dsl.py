"""Patterns built in Python, with the vocabulary of the text form.

    table(
        row(cell(val(avp("PART"), rec(RT))), cell(not_blank(), val(avp("COLOUR")))).one_or_more(),
    )

Elements take an optional guard first, then optional inherited acts(...), then their
children; quantifiers follow as methods.  Cells next to each other form one implicit
subrow, rows one implicit subtable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from gridweave.plans import spec as S

# -- predicates of cells


def blank() -> S.Test:
    return S.Test("blank")


def not_blank() -> S.Test:
    return S.Test("blank", negated=True)


def re(pattern: str) -> S.Test:
    return S.Test("regex", pattern)


def not_re(pattern: str) -> S.Test:
    return S.Test("regex", pattern, True)


def contains(text: str) -> S.Test:
    return S.Test("contains", text)


def not_contains(text: str) -> S.Test:
    return S.Test("contains", text, True)


def where(call: Callable, name: str = "", columnar: bool = False) -> S.Test:
    """A function of the cell's text; columnar: of its Column."""
    return S.Test("ext", name, call=call, columnar=columnar)


# -- providers


@dataclass(frozen=True)
class Prov:
    """A condition with its order and limit, to be combined with and_, or_, card and so on."""

    condition: S.Condition
    most: int | None = 1
    order: str = S.ROW_MAJOR
    kind: str | None = None

    def of_kind(self, kind: str) -> Prov:
        """Only items of this kind: S.VAL, S.ATTR, S.AUX, or S.ANY_KIND for all; otherwise the action says which."""
        return replace(self, kind=kind)

    def and_(self, *others: Prov) -> Prov:
        found = self.condition
        for o in others:
            found = tuple(a + b for a in found for b in o.condition)
        return replace(self, condition=found)

    def or_(self, *others: Prov) -> Prov:
        return replace(self, condition=sum((o.condition for o in others), self.condition))

    def where(self, call: Callable, name: str = "", columnar: bool = False) -> Prov:
        return self.and_(item_where(call, name, columnar))

    def card(self, n: int) -> Prov:
        return replace(self, most=n)

    def unbounded(self) -> Prov:
        return replace(self, most=S.UNBOUNDED)

    def col_major(self) -> Prov:
        return replace(self, order=S.COLUMN_MAJOR)

    def reversed(self) -> Prov:
        return replace(self, order=S.ROW_MAJOR_REVERSED)

    def reversed_col_major(self) -> Prov:
        return replace(self, order=S.COLUMN_MAJOR_REVERSED)

    @property
    def lookup(self) -> S.Lookup:
        return S.Lookup(self.condition, self.most, self.order, self.kind)


def _prov(term: S.Term) -> Prov:
    return Prov(((term,),))


LT, RT, AV, BW, SR, SC, ST, ROW, COL, NCL, CL = (_prov(S.Spatial(n)) for n in S.SPATIAL)
STR = _prov(S.SameText())


def C(low: int, high: int | None = None) -> Prov:
    """A column, or a range of columns."""
    return _prov(S.Place("C", low, high))


def Crel(low: int, high: int | None = None) -> Prov:
    """Columns counted from the anchor's."""
    return _prov(S.Place("C", low, high, True))


def CrelFrom(low: int) -> Prov:
    return _prov(S.Place("C", low, S.NO_END, True))


def R(low: int, high: int | None = None) -> Prov:
    return _prov(S.Place("R", low, high))


def Rrel(low: int) -> Prov:
    return _prov(S.Place("R", low, None, True))


def P(low: int, high: int | None = None) -> Prov:
    return _prov(S.Place("P", low, high))


def Prel(low: int) -> Prov:
    return _prov(S.Place("P", low, None, True))


def tag(name: str) -> Prov:
    return _prov(S.Test("tag", _tag(name)))


def not_tag(name: str) -> Prov:
    return _prov(S.Test("tag", _tag(name), True))


def item(test: S.Test) -> Prov:
    """A test of the candidate's string: item(blank()), item(re("x"))."""
    return _prov(test)


def item_blank() -> Prov:
    return item(blank())


def item_not_blank() -> Prov:
    return item(not_blank())


def item_re(pattern: str) -> Prov:
    return item(re(pattern))


def item_not_re(pattern: str) -> Prov:
    return item(not_re(pattern))


def item_contains(text: str) -> Prov:
    return item(contains(text))


def item_not_contains(text: str) -> Prov:
    return item(not_contains(text))


def item_where(call: Callable, name: str = "", columnar: bool = False) -> Prov:
    """A function of anchor and candidate."""
    return _prov(S.PairTest(name, call, columnar))


def lit(text: str) -> S.Literal:
    return S.Literal(text)


def ctx_avp(attr: str, value: str) -> S.Pair:
    return S.Pair(attr, value)


def _tag(name: str) -> str:
    return "#" + name.removeprefix("#")


def _providers(given: tuple) -> tuple[S.Provider, ...]:
    return tuple(p.lookup if isinstance(p, Prov) else S.Literal(p) if isinstance(p, str) else p for p in given)


# -- settings without a text form


def field_splitting(attr: str, pattern: str, names: list[str] | None = None) -> tuple:
    """A setting: one field split by a regular expression."""
    return "FIELD", attr, pattern, tuple(names) if names else None


def schema_reordering(*names: str) -> tuple:
    """A setting: these fields first."""
    return "ORDER", names


# -- actions


def rec(*providers, at: int | None = None) -> S.Action:
    return S.Action("REC", _providers(providers), at=at)


def rec_split(by: str, *providers) -> S.Action:
    return S.Action("REC", _providers(providers), split=by)


def avp(provider) -> S.Action:
    return S.Action("AVP", _providers((provider,)))


def join(*providers, drop: tuple[int, ...] = ()) -> S.Action:
    return S.Action("JOIN", _providers(providers), drop=tuple(drop))


def fill(*providers, by: str = "") -> S.Action:
    return S.Action("FILL", _providers(providers), text=by)


def prefix(*providers, by: str = "") -> S.Action:
    return S.Action("PREFIX", _providers(providers), text=by)


def suffix(*providers, by: str = "") -> S.Action:
    return S.Action("SUFFIX", _providers(providers), text=by)


@dataclass(frozen=True)
class Acts:
    """Actions that everything below inherits."""

    actions: tuple[S.Action, ...]


def acts(*actions: S.Action) -> Acts:
    return Acts(tuple(replace(a, inherited=True) for a in actions))


# -- contents


@dataclass(frozen=True)
class Atomic:
    """An atom in the making: tagged, extracted, split, given actions."""

    atom: S.Atom

    def tagged(self, *names: str) -> Atomic:
        return Atomic(replace(self.atom, tags=self.atom.tags + tuple(map(_tag, names))))

    def extract(self, *steps) -> Atomic:
        return Atomic(replace(self.atom, extract=self.atom.extract + tuple(s if isinstance(s, tuple) else ("CALL", s, False) for s in steps)))

    def then(self, *actions: S.Action) -> Atomic:
        return Atomic(replace(self.atom, actions=self.atom.actions + actions))

    def split_by(self, by: str) -> S.Delimited:
        return S.Delimited(self.atom, by)


VAL, ATTR, AUX, SKIP = (Atomic(S.Atom(k)) for k in (S.VAL, S.ATTR, S.AUX, S.SKIP))
NORM, TRIM, UC, LC = ("NORM",), ("TRIM",), ("UC",), ("LC",)


def repl(pattern: str, by: str) -> tuple:
    return ("REPL", pattern, by)


def substr(first: int, last: int) -> tuple:
    return ("SUBSTR", first, last)


def val(*actions: S.Action) -> Atomic:
    return VAL.then(*actions)


def attr(*actions: S.Action) -> Atomic:
    return ATTR.then(*actions)


def aux(*actions: S.Action) -> Atomic:
    return AUX.then(*actions)


def _content(c) -> S.Content:
    return c.atom if isinstance(c, Atomic) else c


def compound(*parts) -> S.Compound:
    """Texts are delimiters, the others segments: compound(VAL, ":", VAL)."""
    segments, mark = [], None
    for p in parts:
        if isinstance(p, str):
            mark = p
        else:
            segments.append((mark, _content(p)))
            mark = None
    return S.Compound(tuple(segments), mark)


def when(test: S.Test, then, other) -> S.Conditional:
    return S.Conditional(test, _content(then), _content(other))


# -- structure


@dataclass(frozen=True)
class Element:
    """A cell, row and so on, with its quantifier; inherited actions reach its atoms when it is built."""

    made: S.Cell | S.Subrow | S.Row | S.Subtable

    def _times(self, q: S.Quantifier) -> Element:
        return Element(replace(self.made, times=q))

    def optional(self) -> Element:
        return self._times(S.OPTIONAL)

    def zero_or_more(self) -> Element:
        return self._times(S.ANY)

    def one_or_more(self) -> Element:
        return self._times(S.SOME)

    def exactly(self, n: int) -> Element:
        return self._times(S.exactly(n))


def _inherit(node, given: tuple[S.Action, ...]):
    """The node with actions put before those of every atom in it."""
    match node:
        case None:
            return None
        case S.Atom():
            return replace(node, actions=given + node.actions)
        case S.Delimited():
            return replace(node, atom=_inherit(node.atom, given))
        case S.Compound():
            return replace(node, segments=tuple((m, _inherit(c, given)) for m, c in node.segments))
        case S.Conditional():
            return replace(node, then=_inherit(node.then, given), other=_inherit(node.other, given))
        case S.Cell():
            return replace(node, content=_inherit(node.content, given))
        case S.Subrow():
            return replace(node, cells=tuple(_inherit(c, given) for c in node.cells))
        case S.Row():
            return replace(node, subrows=tuple(_inherit(c, given) for c in node.subrows))
        case S.Subtable():
            return replace(node, rows=tuple(_inherit(c, given) for c in node.rows))
    raise TypeError(f"{node!r} isn't part of a pattern")


def _opened(children: tuple) -> tuple[S.Test | None, tuple[S.Action, ...], list]:
    rest, guard, given = list(children), None, ()
    if rest and isinstance(rest[0], S.Test):
        guard = rest.pop(0)
    while rest and isinstance(rest[0], Acts):
        given += rest.pop(0).actions
    return guard, given, [_inherit(e.made, given) for e in rest]


def cell(*parts) -> Element:
    """cell([guard,] content[, actions...]); a guard alone is a cell without content."""
    rest = list(parts)
    guard = rest.pop(0) if rest and isinstance(rest[0], S.Test) else None
    given: tuple[S.Action, ...] = ()
    while rest and isinstance(rest[0], Acts):
        given += rest.pop(0).actions
    content = _content(rest.pop(0)) if rest else None
    if rest:
        if not isinstance(content, S.Atom):
            raise S.PatternError("actions of a cell need an atom")
        content = replace(content, actions=content.actions + tuple(rest))
    if isinstance(content, S.Atom) and content.kind == S.SKIP:
        content = None
    return Element(S.Cell(_inherit(content, given), guard))


def skip() -> Element:
    return Element(S.Cell())


def subrow(*parts) -> Element:
    guard, _, cells = _opened(parts)
    return Element(S.Subrow(tuple(cells), guard))


def _grouped(made: list, single: type, group: Callable) -> tuple:
    """Runs of single elements become one implicit group each."""
    out, run = [], []
    for m in made:
        if isinstance(m, single):
            run.append(m)
            continue
        if run:
            out.append(group(tuple(run)))
            run = []
        out.append(m)
    return tuple(out + ([group(tuple(run))] if run else []))


def row(*parts) -> Element:
    guard, _, made = _opened(parts)
    return Element(S.Row(_grouped(made, S.Cell, S.Subrow), guard))


def subtable(*parts) -> Element:
    guard, _, made = _opened(parts)
    return Element(S.Subtable(tuple(made), guard))


def norm() -> tuple:
    return ("NORM",)


def anch(n: int) -> tuple:
    return ("ANCH", n)


def split(by: str) -> tuple:
    return ("SPLIT", by)


def table(*parts) -> S.Table:
    """table([guard,] [settings...,] [acts(...),] rows or subtables)."""
    rest = list(parts)
    guard = rest.pop(0) if rest and isinstance(rest[0], S.Test) else None
    settings = []
    while rest and isinstance(rest[0], tuple):
        settings.append(rest.pop(0))
    _, _, made = _opened(tuple(rest))
    return S.with_inline_settings(S.Table(_grouped(made, S.Row, S.Subtable), guard, tuple(settings)))
