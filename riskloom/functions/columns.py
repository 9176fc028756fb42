"""Choosing, naming and ordering columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a symbol in a heading becomes in a cleaned name.
SYMBOL_WORDS = {"%": "percent", "#": "number"}


def ref(name: str) -> Column:
    """Column by literal name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: str) -> str:
    """snake_case form of one heading: ``LoF`` -> ``lo_f``, ``% cover`` -> ``percent_cover``."""
    text = name.replace("'", "").replace('"', "")
    for symbol, word in SYMBOL_WORDS.items():
        text = text.replace(symbol, f" {word} ")
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text)
    text = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    if not text:
        return "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; repeats get ``_2``, ``_3``, ..."""
    taken: set[str] = set()
    fresh = []
    for name in df.columns:
        base = candidate = clean_name(name)
        copy = 1
        while candidate in taken:
            copy += 1
            candidate = f"{base}_{copy}"
        taken.add(candidate)
        fresh.append(candidate)
    return df.toDF(*fresh)


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in frame order."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    if stop < start:
        raise ValueError(f"{last!r} stands before {first!r}")
    return names[start : stop + 1]


def cols_at(df: DataFrame, *positions: int) -> list[str]:
    """Names at zero-based positions."""
    return [df.columns[i] for i in positions]


def question(df: DataFrame, number: int) -> str:
    """Name of the column whose heading starts with a question number."""
    found = [c for c in df.columns if re.match(rf"{number}\b", c)]
    if len(found) != 1:
        raise ValueError(f"question {number}: {len(found)} columns")
    return found[0]


def drop_at(df: DataFrame, *positions: int) -> DataFrame:
    """Drop by zero-based position."""
    gone = {i % len(df.columns) for i in positions}
    return df.select(*[ref(c) for i, c in enumerate(df.columns) if i not in gone])


def cols_where(
    df: DataFrame,
    numeric: bool | None = None,
    contains: str | None = None,
    without: str | None = None,
    test: Callable[[T.StructField], bool] | None = None,
) -> list[str]:
    """Names that pass every given test on type or name."""
    out = []
    for field in df.schema.fields:
        if numeric is not None and isinstance(field.dataType, T.NumericType) != numeric:
            continue
        if contains is not None and contains not in field.name:
            continue
        if without is not None and without in field.name:
            continue
        if test is not None and not test(field):
            continue
        out.append(field.name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """Every column but ``names``, in frame order."""
    gone = set(names)
    return [c for c in df.columns if c not in gone]


def relocate(
    df: DataFrame, names: str | Sequence[str], after: str | None = None, before: str | None = None
) -> DataFrame:
    """Move columns behind/ahead of another one; to the front when neither is given."""
    moved = [names] if isinstance(names, str) else list(names)
    rest = others(df, *moved)
    if after is not None:
        at = rest.index(after) + 1
    elif before is not None:
        at = rest.index(before)
    else:
        at = 0
    return df.select(*[ref(c) for c in rest[:at] + moved + rest[at:]])


def rename_from(df: DataFrame, lookup: DataFrame | Mapping[str, str], old: str = "", new: str = "") -> DataFrame:
    """Rename by an old -> new list.

    A lookup frame is filtered to this frame's own column names before it is read, so what
    reaches the driver is never longer than the heading row.
    """
    if isinstance(lookup, DataFrame):
        wanted = lookup.where(ref(old).isin(*df.columns) & ref(new).isNotNull())
        lookup = {r[0]: r[1] for r in wanted.select(ref(old), ref(new)).distinct().collect()}
    return df.withColumnsRenamed(dict(lookup))


def across(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each named column by ``fn`` of it, in one projection."""
    return df.withColumns({c: fn(ref(c)) for c in names})


def derive_unused(df: DataFrame, name: str, value: Column, inputs: Sequence[str], after: str | None = None) -> DataFrame:
    """Add ``name`` and drop the columns it was made from."""
    out = df.withColumn(name, value).drop(*[c for c in inputs if c != name])
    return relocate(out, name, after=after) if after else out


def columns_with_nulls(df: DataFrame) -> list[str]:
    """Names of the columns that hold at least one null (one pass, one row back)."""
    probe = [F.max(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*probe).first()
    return [c for i, c in enumerate(df.columns) if row[i]]
