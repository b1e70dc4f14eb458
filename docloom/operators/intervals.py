"""Joins of intervals that overlap, by bins whose width follows each interval's own length.

An interval belongs to the level of its length: on level k bins are FINEST * STEP^k wide, the least such width that
is not less than the interval, so it touches two bins of its level at most. Of two intervals that overlap, the one
of the lower level looks the other up on the other's level, where it touches two bins at most, too. Every interval
thus makes two rows for each level that occurs on the other side (about 20 levels cover all lengths of a long), however
long it is; a pair is reported in the one bin that holds the later of the two starts, so nothing has to be made
distinct. The join is an equi-join on keys, level and bin, which adaptive execution can split where a bin is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINEST, STEP = 16, 8
_OWN = ("__level", "__bin", "__at", "__to")


def _level(length: Column) -> Column:
    """The least k with FINEST * STEP^k >= length, in whole numbers."""
    widths, width = [], FINEST
    while width < 1 << 62:
        widths.append(width)
        width *= STEP
    out = F.lit(len(widths))
    for k in reversed(range(len(widths))):
        out = F.when(length <= widths[k], k).otherwise(out)
    return out


def _bins(df: DataFrame, level: Column) -> DataFrame:
    """A row for each bin of the level that the interval touches. Levels are few, so the width is a choice of constants."""
    width = F.element_at(F.array(*[F.lit(FINEST * STEP**k) for k in range(20)]), level + 1)
    first, last = F.floor(F.col("__at") / width), F.floor((F.col("__to") - 1) / width)
    return df.withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _prepared(df: DataFrame, keys: list[str], span: tuple[str, str], prefix: str) -> DataFrame:
    at, to = (F.col(c).cast("long") for c in span)
    out = df.select(*keys, F.struct(*[c for c in df.columns]).alias(prefix), at.alias("__at"), to.alias("__to"))
    return out.where(F.col("__to") > F.col("__at")).withColumn("__own", _level(F.col("__to") - F.col("__at")))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals [start, end) overlap: keys, `left` and `right`, structs
    of the rows' columns.

    Cases: empty intervals, those that end before they start, and null keys or ends have no pairs; repeated rows pair
    each on their own; negative starts are fine; columns of the two sides may share names, as they stay in structs. Starts,
    ends and their differences must lie within 2^52, as the bins are found by division of doubles."""
    one, two = _prepared(left, keys, left_span, "left"), _prepared(right, keys, right_span, "right")
    # The levels that occur: at most 20 rows of one number each.
    levels_one = sorted(r[0] for r in one.select("__own").distinct().collect())
    levels_two = sorted(r[0] for r in two.select("__own").distinct().collect())

    def met(placed: DataFrame, looking: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
        """placed stands on its own level; looking visits every level above its own (or from its own on)."""
        on = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
        above = F.filter(on, lambda k: k > F.col("__own") if strictly else k >= F.col("__own"))
        visits = _bins(looking.withColumn("__visit", F.explode(above)), F.col("__visit")).drop("__visit", "__own")
        stands = _bins(placed, F.col("__own")).drop("__own").withColumnsRenamed({"__at": "__at2", "__to": "__to2"})
        width = F.element_at(F.array(*[F.lit(FINEST * STEP**k) for k in range(20)]), F.col("__level") + 1)
        later = F.greatest("__at", "__at2")
        return (
            stands.join(visits, [*keys, "__level", "__bin"])
            .where((F.col("__at") < F.col("__to2")) & (F.col("__at2") < F.col("__to")) & (F.floor(later / width) == F.col("__bin")))
            .select(*keys, "left", "right")
        )

    return met(one, two, levels_one, False).unionByName(met(two, one, levels_two, True))
