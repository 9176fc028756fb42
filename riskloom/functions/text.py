"""Text and category columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every word; a hyphen starts a new word too."""
    parts = F.split(F.lower(text), "-")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "-")


def after_last_comma(text: Column) -> Column:
    """The text after the last comma from its first word character on; null when there is none.

    Cut by position first, so that the pattern only ever sees the tail.
    """
    tail = F.regexp_replace(F.substring_index(text, ",", -1), r"^[^\p{L}\p{M}\p{N}_]+", "")
    return F.when(tail != "", tail)


def strip_all(text: Column, characters: str) -> Column:
    """Remove every occurrence of the given characters."""
    return F.translate(text, characters, "")


def has_pattern(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def if_known(test: Column, yes: object, no: object) -> Column:
    """Two-way choice that stays null when the test is null."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test, yes).when(~test, no)


def yes_no(text: Column, pattern: str = "Yes") -> Column:
    """``Yes`` where the text holds the pattern, ``No`` where not, null where unknown."""
    return if_known(text.rlike(pattern), "Yes", "No")


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Map old -> new; values outside the mapping stay, nulls stay null."""
    if not mapping:
        return value
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.element_at(table, value), value)


def collapse(value: Column, new: str, old: Sequence[str]) -> Column:
    """Fold several levels into one."""
    return F.when(value.isin(*old), F.lit(new)).otherwise(value)


def level_rank(value: Column, levels: Sequence[str], other: int | None = None) -> Column:
    """Position (from 1) of a value in a stated level order; levels not listed come last."""
    order = F.create_map(*[F.lit(x) for x in chain.from_iterable((v, i + 1) for i, v in enumerate(levels))])
    last = len(levels) + 1 if other is None else other
    return F.when(value.isNotNull(), F.coalesce(F.element_at(order, value), F.lit(last)))
