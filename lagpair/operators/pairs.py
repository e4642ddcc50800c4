"""Consecutive visits of a subject as (before, after) pairs, and which of them have instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagpair.functions.sessions import head_date, head_id, name_head, zero_padded
from lagpair.operators.ranking import ranked


def _parsed(metadata: DataFrame, mode: str) -> DataFrame:
    heads = metadata.select("group_name").distinct().withColumn("head", name_head(F.col("group_name")))
    return heads.select("group_name", head_id(F.col("head")).alias("id"), head_date(F.col("head"), mode).alias("d"))


def sessions(metadata: DataFrame, mode: str = "permissive") -> DataFrame:
    """Distinct session names with id and date. Names that do not parse are dropped, or an error in strict mode."""
    parsed = _parsed(metadata, mode)
    if mode == "strict":
        return parsed.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit("no session name: "), F.coalesce("group_name", F.lit("null")))).cast("string")))
    return parsed.where("id is not null and d is not null")


def rejected(metadata: DataFrame) -> DataFrame:
    """Distinct names that do not parse: diagnostics of what :func:`sessions` drops."""
    return _parsed(metadata, "permissive").where("id is null or d is null").select("group_name")


def consecutive(visits: DataFrame, tie: str | None = None, min_gap_days: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, before, after, gap_days) of each visit of (id, d) and the subject's next one; ties on a day go by ``tie``.
    Columns of ``carry`` come along as name_before and name_after.

    The next visit is sought within the subject's month, and for the last one there among the first visits of the
    subject's months, so that a subject with a third of all visits is not one task's.
    """
    fields = ["d"] + ([tie] if tie else [])
    visit = F.struct(*fields, *carry)
    rows = visits.select("id", *fields, *carry).where("id is not null and d is not null").withColumn("month", F.trunc("d", "MM"))
    inside = Window.partitionBy("id", "month").orderBy(*fields)
    firsts = rows.groupBy("id", "month").agg(F.min(visit).alias("first"))
    onward = firsts.select("id", "month", F.lead("first").over(Window.partitionBy("id").orderBy("month")).alias("onward"))
    out = rows.withColumn("next", F.lead(visit).over(inside)).join(onward, ["id", "month"]).withColumn("next", F.coalesce("next", "onward")).where("next is not null")
    gap = F.datediff(F.col("next.d"), "d").cast("long")
    along = [c for name in carry for c in (F.col(name).alias(f"{name}_before"), F.col(f"next.{name}").alias(f"{name}_after"))]
    found = out.select("id", F.col("d").alias("before"), F.col("next.d").alias("after"), gap.alias("gap_days"), *along)
    return found.where(F.col("gap_days") >= min_gap_days) if min_gap_days else found


def pair_parts(pairs: DataFrame, *more: str) -> DataFrame:
    """Pairs with the zero-padded date parts of the pair file, and the columns ``more``."""
    def parts(day: str, side: str):
        return [zero_padded(f(day), w).alias(f"{n}_{side}") for f, w, n in ((F.year, 4, "Year"), (F.month, 2, "Month"), (F.day, 2, "Day"))]

    return pairs.select(F.col("id").alias("ID"), *parts("before", "Before"), *parts("after", "After"), *more)


def instances(index: DataFrame) -> DataFrame:
    """(id, d, idx, k, n): the instances of each visit date, numbered from 0 by idx (and by ``tie``, where there is one), and how
    many there are."""
    ties = ["tie"] if "tie" in index.columns else []
    return ranked(index.select("id", "d", "idx", *ties), ["idx", *ties], ("id", "d"), "k", "n").select("id", "d", "idx", "k", "n")


def date_index(index: DataFrame) -> DataFrame:
    """(id, d, idxs): the sorted instances of each visit date as an array. For dates whose instances fit a row; :func:`instances` has no such bound."""
    return index.groupBy("id", "d").agg(F.array_sort(F.collect_list("idx")).alias("idxs"))


def valid(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of which both dates have an instance; duplicates stay."""
    keys = index.select("id", "d").distinct()
    for side in ("before", "after"):
        pairs = pairs.join(keys.select("id", F.col("d").alias(side)), ["id", side], "left_semi")
    return pairs


def invalid(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of which a date has no instance (extension: diagnostics); duplicates stay."""
    keys = index.select("id", "d").distinct()
    before, after = (keys.select("id", F.col("d").alias(side)) for side in ("before", "after"))
    no_before = pairs.join(before, ["id", "before"], "left_anti").select(*pairs.columns)
    no_after = pairs.join(before, ["id", "before"], "left_semi").join(after, ["id", "after"], "left_anti").select(*pairs.columns)
    return no_before.unionByName(no_after)
