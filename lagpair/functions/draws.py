"""Reproducible draws: integers of a hash, alike in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**28 - 1 of the parts, joined by a bar."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 7), 16, 10).cast("long")
