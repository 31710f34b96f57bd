"""Changes to finished records: columns in, columns out, keys carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import text as T

#: Columns that say which record a row is.
KEYS = ("table_id", "rec_no")


def _fields(df: DataFrame, keys: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whitespace_normalized(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every value without blanks at its ends and with single spaces inside."""
    return df.select(*keys, *(T.normalized(_col(c)).alias(c) for c in _fields(df, keys)))


def anchor_at(df: DataFrame, position: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first column's values move to a position, those up to there move left; names stay."""
    if position < 0:
        raise ValueError("a position is 0 or more")
    names = _fields(df, keys)
    if position == 0 or position >= len(names):
        return df
    values = [*names[1 : position + 1], names[0], *names[position + 1 :]]
    return df.select(*keys, *(_col(v).alias(n) for v, n in zip(values, names, strict=True)))


def _within(parts: Column, width: int, name: str) -> Column:
    """The parts; more of them than the declared width are an error when the plan runs."""
    message = F.concat(F.lit(f"{name} has more than {width} parts: "), F.size(parts).cast("string"))
    return F.when(F.size(parts) > width, F.raise_error(message).cast("array<string>")).otherwise(parts)


def delimited_split(df: DataFrame, by: str, only: list[str] | None = None, template: str = "$a_%i", keys: tuple[str, ...] = KEYS, widths: dict[str, int] | None = None) -> DataFrame:
    """Each (listed) column split at a text into as many columns as its values have parts at most.

    If any column splits, all columns are named by the template.  Missing parts are empty.
    widths: how many columns each becomes, 1 if not named.  With it nothing runs before the
    result is used, and a value of more parts is an error; without, one job finds the widths.
    """
    names = _fields(df, keys)
    split = [n for n in names if only is None or n in only]
    if not split:
        return df
    if widths is None:
        sizes = df.agg(*(F.max(F.size(T.split(_col(n), by))).alias(f"n{i}") for i, n in enumerate(split))).first()
        parts = {n: max(1, sizes[i] or 1) for i, n in enumerate(split)}
    else:
        parts = {n: widths.get(n, 1) for n in split}
    if max(parts.values()) < 2:
        return df
    values = lambda n: _within(T.split(_col(n), by), parts[n], n) if widths is not None else T.split(_col(n), by)
    out = []
    for n in names:
        if n in parts and (parts[n] > 1 or widths is not None):
            out += [F.coalesce(F.get(values(n), F.lit(i)), F.lit("")) for i in range(parts[n])]
        else:
            out.append(F.coalesce(_col(n), F.lit("")) if n in parts else _col(n))
    return df.select(*keys, *(c.alias(template.replace("%i", str(i))) for i, c in enumerate(out, 1)))


def field_split(df: DataFrame, attr: str, pattern: str, names: list[str] | None = None, keys: tuple[str, ...] = KEYS, widths: dict[str, int] | None = None) -> DataFrame:
    """One column split by a regular expression; parts are named, or attr_1, attr_2, ...; missing parts are null.

    widths: as in `delimited_split`; names tell the width, too.
    """
    if attr not in _fields(df, keys):
        return df
    parts = F.split(_col(attr), T.FLAGS + pattern, -1)
    if widths is None:
        n = df.agg(F.max(F.size(parts))).first()[0] or 1
    else:
        n = widths.get(attr) or (len(names) if names else 1)
    if n < 2:
        return df
    names = names or [f"{attr}_{i}" for i in range(1, n + 1)]
    if len(names) != n:
        raise ValueError(f"{len(names)} names for {n} parts")
    parts = _within(parts, n, attr) if widths is not None else parts
    out = []
    for c in _fields(df, keys):
        out += [F.get(parts, F.lit(i)).alias(m) for i, m in enumerate(names)] if c == attr else [_col(c).alias(c)]
    return df.select(*keys, *out)


def reordered(df: DataFrame, order: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The columns listed first, as far as they are there, then the others as they were."""
    names = _fields(df, keys)
    first = [n for n in dict.fromkeys(order) if n in names]
    return df.select(*keys, *(_col(n) for n in [*first, *(n for n in names if n not in first)]))


def with_missing(df: DataFrame, handler, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Null values replaced by what the handler says for their column; it is asked once a column."""
    return df.select(*keys, *(_col(n).alias(n) if (v := handler(n)) is None else F.coalesce(_col(n), F.lit(v)).alias(n) for n in _fields(df, keys)))


def applied(df: DataFrame, settings: tuple[tuple, ...], keys: tuple[str, ...] = KEYS, widths: dict[str, int] | None = None) -> DataFrame:
    """A pattern's settings in order."""
    for s in settings:
        match s:
            case ("NORM",):
                df = whitespace_normalized(df, keys)
            case ("ANCH", n):
                df = anchor_at(df, n, keys)
            case ("SPLIT", by):
                df = delimited_split(df, by, keys=keys, widths=widths)
            case ("FIELD", attr, pattern, names):
                df = field_split(df, attr, pattern, list(names) if names else None, keys, widths)
            case ("ORDER", names):
                df = reordered(df, list(names), keys)
    return df
