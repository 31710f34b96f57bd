"""Patterns built level by level: X.of([guard,] [quantifier,] children...).

    TablePattern.of(RowPattern.of(ONE_OR_MORE, CellPattern.of(VAL.then(rec(RT))), CellPattern.of(VAL)))

The parts are those of `dsl`; this is another way to put them together.
"""

from __future__ import annotations

from collections.abc import Callable

from gridweave.plans import dsl
from gridweave.plans import spec as S

ONE, ZERO_OR_ONE, ZERO_OR_MORE, ONE_OR_MORE = S.ONE, S.OPTIONAL, S.ANY, S.SOME


def _of(build: Callable[..., dsl.Element], parts: tuple) -> dsl.Element:
    rest = list(parts)
    guard = [rest.pop(0)] if rest and isinstance(rest[0], S.Test) else []
    times = rest.pop(0) if rest and isinstance(rest[0], S.Quantifier) else S.ONE
    return build(*guard, *rest)._times(times)


class CellPattern:
    @staticmethod
    def of(*parts) -> dsl.Element:
        return _of(dsl.cell, parts)

    @staticmethod
    def skip(times: S.Quantifier = S.ONE) -> dsl.Element:
        return dsl.skip()._times(times)


class SubrowPattern:
    @staticmethod
    def of(*parts) -> dsl.Element:
        return _of(dsl.subrow, parts)


class RowPattern:
    @staticmethod
    def of(*parts) -> dsl.Element:
        """A row of cells or of subrows, not both."""
        kinds = {type(p.made) for p in parts if isinstance(p, dsl.Element)}
        if len(kinds) > 1:
            raise S.PatternError("a row has cells or subrows")
        return _of(dsl.row, parts)


class SubtablePattern:
    @staticmethod
    def of(*parts) -> dsl.Element:
        return _of(dsl.subtable, parts)


class TablePattern:
    @staticmethod
    def of(*parts) -> S.Table:
        return dsl.table(*parts)
