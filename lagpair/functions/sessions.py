"""Session names ``ID_YYYY_MM_DD_...`` as columns. Ids stay strings, so 007 and 7 are two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a session name begins with.
NAME_PATTERN = r"^(\d+)_(\d{4})_(\d{2})_(\d{2})"
#: What a session name begins with, as one piece.
WHOLE_PATTERN = r"^\d+_\d{4}_\d{2}_\d{2}"
MODES = ("permissive", "strict")


def name_part(name: Column, group: int) -> Column:
    """Part 1 to 4 of a name; null if the name is not of the pattern."""
    return F.nullif(F.regexp_extract(name, NAME_PATTERN, group), F.lit(""))


def name_head(name: Column) -> Column:
    """The part of a name that the pattern covers; empty if it is not of the pattern. One match gives all four parts."""
    return F.regexp_extract(name, WHOLE_PATTERN, 0)


def head_id(head: Column) -> Column:
    return F.nullif(F.substring_index(head, "_", 1), F.lit(""))


def head_date(head: Column, mode: str = "permissive") -> Column:
    """The date at the end of a head of :func:`name_head`; an impossible one is null, or an error in strict mode."""
    text = F.nullif(F.translate(F.right(head, F.lit(10)), "_", "-"), F.lit(""))
    return text.cast("date") if _strict(mode) else text.try_cast("date")


def split_part(name: Column, place: int, mode: str = "permissive") -> Column:
    """The place-th part (from 0) between underscores as an int: null, or in strict mode an error, if it is none."""
    part = F.get(F.split(name, "_"), F.lit(place))
    return part.cast("int") if _strict(mode) else part.try_cast("int")


def session_date(year: Column, month: Column, day: Column, mode: str = "strict") -> Column:
    """A date of its parts. Null parts give null; an impossible date is an error in strict mode, else null."""
    if _strict(mode):
        return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), zero_padded(month), zero_padded(day)), "yyyy-MM-dd")


def zero_padded(part: Column, width: int = 2) -> Column:
    """The text before any dot, padded on the left with zeros; longer text is not cut."""
    whole = F.substring_index(part.cast("string"), ".", 1)
    return F.when(F.length(whole) >= width, whole).otherwise(F.lpad(whole, width, "0"))


def _strict(mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}, not one of {MODES}")
    return mode == "strict"
