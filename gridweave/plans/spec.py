"""Patterns of document tables, as plain values.

A Table holds Subtables, these Rows, these Subrows, these Cells; each may have a guard (a
predicate every cell must meet) and a quantifier.  A cell's content says which items its
text gives; an item's actions relate it to other items, found by providers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

VAL, ATTR, AUX, SKIP = "VAL", "ATTR", "AUX", "SKIP"
ANY_KIND = "ANY"
UNBOUNDED = None
#: The upper number of a range without an end.
NO_END = 1 << 31
#: Orders in which a provider looks through the candidates.
ROW_MAJOR, ROW_MAJOR_REVERSED, COLUMN_MAJOR, COLUMN_MAJOR_REVERSED = "", "-", "^", "-^"
SPATIAL = ("LT", "RT", "AV", "BW", "SR", "SC", "ST", "ROW", "COL", "NCL", "CL")


class PatternError(ValueError):
    """A pattern that can't be built; line and col where it was read from text."""

    def __init__(self, message: str, line: int | None = None, col: int | None = None):
        super().__init__(message if line is None else f"{line}:{col}: {message}")
        self.line, self.col = line, col


@dataclass(frozen=True)
class Quantifier:
    low: int = 1
    high: int | None = 1

    @property
    def mark(self) -> str:
        return {(1, 1): "", (0, 1): "?", (0, None): "*", (1, None): "+"}.get((self.low, self.high)) or (f"{{{self.low}}}" if (self.low, self.high) != (1, 1) else "")


ONE, OPTIONAL, ANY, SOME = Quantifier(), Quantifier(0, 1), Quantifier(0, None), Quantifier(1, None)


def exactly(n: int) -> Quantifier:
    if n < 2:
        raise PatternError("an exact count is 2 or more")
    return Quantifier(n, n)


@dataclass(frozen=True)
class Test:
    """A test of a string: kind is blank, regex, contains, tag, or ext; arg its text.

    An ext test is a function: of a text Column (columnar), or of a cell in Python.
    """

    kind: str
    arg: str = ""
    negated: bool = False
    call: Callable | None = field(default=None, compare=True)
    columnar: bool = False


@dataclass(frozen=True)
class Spatial:
    """A term on two places: LT, RT, AV, BW, SR, SC, ST, ROW, COL, NCL, CL."""

    name: str


@dataclass(frozen=True)
class Place:
    """A term on one axis (C, R or P).  relative: numbers count from the anchor.  high: None for one number, NO_END for no end."""

    axis: str
    low: int
    high: int | None = None
    relative: bool = False


@dataclass(frozen=True)
class SameText:
    """The candidate's string equals the anchor's."""


@dataclass(frozen=True)
class PairTest:
    """A function of anchor and candidate: of two struct Columns (columnar), or of two items in Python."""

    name: str
    call: Callable
    columnar: bool = False


Term = Test | Spatial | Place | SameText | PairTest
#: A disjunction of conjunctions of terms.
Condition = tuple[tuple[Term, ...], ...]


@dataclass(frozen=True)
class Whole:
    """A test of a whole cell, a struct, instead of its text."""

    call: Callable

    def __call__(self, cell):
        return self.call(cell)


@dataclass(frozen=True)
class Lookup:
    """Items of the table that meet the condition, in order, at most `most` of them."""

    condition: Condition
    most: int | None = 1
    order: str = ROW_MAJOR
    #: VAL, ATTR, AUX, ANY_KIND, or None for what its action asks for.
    kind: str | None = None

    def __post_init__(self):
        if self.kind not in (None, VAL, ATTR, AUX, ANY_KIND):
            raise PatternError(f"no kind of item: {self.kind}")


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Pair:
    """A constant field of a record."""

    attr: str
    value: str


Provider = Lookup | Literal | Pair


@dataclass(frozen=True)
class Action:
    """op is FILL, PREFIX, SUFFIX, AVP, REC or JOIN; text the delimiter, at the record position, drop the positions a join leaves out."""

    op: str
    providers: tuple[Provider, ...] = ()
    text: str = ""
    at: int | None = None
    split: str | None = None
    drop: tuple[int, ...] = ()
    inherited: bool = False

    def __post_init__(self):
        for p in self.providers:
            if isinstance(p, Literal) and self.op == "JOIN":
                raise PatternError("JOIN takes no literals")
            if isinstance(p, Pair) and self.op != "REC":
                raise PatternError("a constant pair serves REC only")
        if self.op == "AVP" and (len(self.providers) != 1):
            raise PatternError("AVP takes one provider")
        if self.at is not None and self.at < 0:
            raise PatternError("a position is 0 or more")
        if self.op == "AVP":
            object.__setattr__(self, "providers", tuple(replace(p, most=1) if isinstance(p, Lookup) else p for p in self.providers))


@dataclass(frozen=True)
class Atom:
    kind: str
    tags: tuple[str, ...] = ()
    extract: tuple[tuple, ...] = ()
    actions: tuple[Action, ...] = ()


@dataclass(frozen=True)
class Delimited:
    atom: Atom
    by: str

    def __post_init__(self):
        if not self.by:
            raise PatternError("a delimiter isn't empty")


@dataclass(frozen=True)
class Compound:
    """Segments, each after its leading delimiter (None: none), and a closing delimiter."""

    segments: tuple[tuple[str | None, Atom | Delimited], ...]
    close: str | None = None


@dataclass(frozen=True)
class Conditional:
    test: Test
    then: Content
    other: Content


Content = Atom | Delimited | Compound | Conditional


@dataclass(frozen=True)
class Cell:
    content: Content | None = None
    guard: Test | None = None
    times: Quantifier = ONE


@dataclass(frozen=True)
class Subrow:
    cells: tuple[Cell, ...]
    guard: Test | None = None
    times: Quantifier = ONE


@dataclass(frozen=True)
class Row:
    subrows: tuple[Subrow, ...]
    guard: Test | None = None
    times: Quantifier = ONE


@dataclass(frozen=True)
class Subtable:
    rows: tuple[Row, ...]
    guard: Test | None = None
    times: Quantifier = ONE


@dataclass(frozen=True)
class Table:
    """settings, in order, are applied to the finished records: ("NORM",), ("ANCH", n), ("SPLIT", s),
    and, without a text form, ("FIELD", attribute, regex, names or None) and ("ORDER", names)."""

    subtables: tuple[Subtable, ...]
    guard: Test | None = None
    settings: tuple[tuple, ...] = ()

    def with_transformations(self, *settings: tuple) -> Table:
        """The pattern with these settings in place of its own."""
        for s in settings:
            if not s or s[0] not in ("NORM", "ANCH", "SPLIT", "FIELD", "ORDER"):
                raise PatternError(f"no setting: {s!r}")
        return replace(self, settings=settings)


def atoms_of(content: Content | None) -> list[Atom]:
    """The atoms of a content, left to right."""
    match content:
        case None:
            return []
        case Atom():
            return [content]
        case Delimited():
            return [content.atom]
        case Compound():
            return [a for _, c in content.segments for a in atoms_of(c)]
        case Conditional():
            return [*atoms_of(content.then), *atoms_of(content.other)]


def contents(table: Table) -> list[Content]:
    """The contents of all cells in order."""
    return [c.content for t in table.subtables for r in t.rows for s in r.subrows for c in s.cells if c.content is not None]


def with_inline_settings(table: Table) -> Table:
    """Positions and splits given in REC become settings; different ones contradict each other."""
    recs = [a for c in contents(table) for atom in atoms_of(c) for a in atom.actions if a.op == "REC"]
    settings = list(table.settings)
    for name, values in (("ANCH", [a.at for a in recs if a.at is not None]), ("SPLIT", [a.split for a in recs if a.split is not None])):
        wanted = list(dict.fromkeys([s[1] for s in settings if s[0] == name] + values))
        if len(wanted) > 1:
            raise PatternError(f"{name} is given as {' and '.join(map(repr, wanted))}")
        if wanted and not any(s[0] == name for s in settings):
            settings.append((name, wanted[0]))
    return replace(table, settings=tuple(settings))
