"""The canonical text of a pattern; reading it gives the pattern again."""

from __future__ import annotations

from gridweave.plans import spec as S


def to_text(table: S.Table) -> str:
    """The text of a pattern; PatternError if it holds Python functions without a name."""
    guard = _guard(table.guard)
    settings = f"<{', '.join(_setting(s) for s in table.settings)}> " if table.settings else ""
    plain = len(table.subtables) == 1 and table.subtables[0].guard is None and table.subtables[0].times == S.ONE
    body = " ".join(map(_row, table.subtables[0].rows)) if plain else " ".join(map(_subtable, table.subtables))
    return f"{guard}{settings}{body}"


def _setting(s: tuple) -> str:
    return {"NORM": "NORM", "ANCH": f"ANCH({s[-1]})", "SPLIT": f'SPLIT("{s[-1]}")'}[s[0]]


def _guard(test: S.Test | None) -> str:
    return f"{_test(test)}? " if test else ""


def _test(t: S.Test) -> str:
    mark = "!" * t.negated
    match t.kind:
        case "blank":
            return f"{mark}BLANK"
        case "regex":
            return f'{mark}"{t.arg}"'
        case "contains":
            return f'{mark}~"{t.arg}"'
        case "tag":
            return f"{mark}#'{t.arg.removeprefix('#')}'"
    if not t.arg:
        raise S.PatternError("a function without a name has no text")
    return f"EXT('{t.arg}')"


def _subtable(t: S.Subtable) -> str:
    return f"{{ {_guard(t.guard)}{' '.join(map(_row, t.rows))} }}{t.times.mark}"


def _row(r: S.Row) -> str:
    return f"[ {_guard(r.guard)}{' '.join(map(_subrow, r.subrows))} ]{r.times.mark}"


def _subrow(s: S.Subrow) -> str:
    cells = " ".join(map(_cell, s.cells))
    return cells if s.guard is None and s.times == S.ONE else f"{{ {_guard(s.guard)}{cells} }}{s.times.mark}"


def _cell(c: S.Cell) -> str:
    parts = [*([_test(c.guard) + ("?" if c.content else "")] if c.guard else []), *([_content(c.content)] if c.content else [])]
    return f"[{f' {" ".join(parts)} ' if parts else ''}]{c.times.mark}"


def _content(c: S.Content) -> str:
    match c:
        case S.Atom():
            return _atom(c)
        case S.Delimited():
            return f'({_atom(c.atom)}){{"{c.by}"}}'
        case S.Compound():
            out = []
            for lead, segment in c.segments:
                out += [*([f'"{lead}"'] if lead is not None else []), _content(segment)]
            return " ".join([*out, *([f'"{c.close}"'] if c.close is not None else [])])
        case S.Conditional():
            return f"{_test(c.test)}? {_content(c.then)} | {_content(c.other)}"


def _atom(a: S.Atom) -> str:
    out = a.kind + "".join(f" #'{t.removeprefix('#')}'" for t in a.tags)
    if a.extract:
        out += " = " + ".".join(map(_step, a.extract))
    if a.actions:
        out += " : " + ", ".join(map(_action, a.actions))
    return out


def _step(s: tuple) -> str:
    match s:
        case ("SUBSTR", first, last):
            return f"SUBSTR({first},{last - first})"
        case ("REPL", what, by):
            return f'REPL("{what}","{by}")'
        case (name,):
            return name
    raise S.PatternError("a function has no text")


def _action(a: S.Action) -> str:
    providers = [_provider(p) for p in a.providers]
    return f"{providers[0] if len(providers) == 1 else f'({", ".join(providers)})'}->{_operation(a)}"


def _operation(a: S.Action) -> str:
    if a.op == "REC":
        return "REC" + (f"({a.at})" if a.at is not None else f"('{a.split}')" if a.split is not None else "")
    if a.op == "JOIN":
        return "JOIN" + (f"({', '.join(map(str, a.drop))})" if a.drop else "")
    return a.op + (f'("{a.text}")' if a.text else "")


def _provider(p: S.Provider) -> str:
    match p:
        case S.Literal(text):
            return f"'{text}'"
        case S.Pair(attr, value):
            return f"@'{attr}'='{value}'"
    most = "*" if p.most is None else f"{{{p.most}}}" if p.most != 1 else ""
    return f"{p.order}{_condition(p.condition)}{most}"


def _condition(c: S.Condition) -> str:
    if len(c) == 1 and len(c[0]) == 1:
        return _term(c[0][0]) if not isinstance(c[0][0], S.Test | S.SameText | S.PairTest) else f"({_term(c[0][0])})"
    if len(c) == 1:
        return f"({' & '.join(map(_term, c[0]))})"
    return f"({' | '.join(f'({" & ".join(map(_term, x))})' for x in c)})"


def _term(t: S.Term) -> str:
    match t:
        case S.Spatial(name):
            return name
        case S.SameText():
            return "STR"
        case S.Test():
            return _test(t)
        case S.PairTest(name):
            if not name:
                raise S.PatternError("a function without a name has no text")
            return f"EXT('{name}')"
        case S.Place(axis, low, None, relative):
            return f"{axis}{low:+d}" if relative else f"{axis}{low}"
        case S.Place(axis, low, high, relative):
            number = (lambda n: f"{n:+d}") if relative else str
            return f"{axis}{number(low)}..{'' if high == S.NO_END else number(high)}"
