"""Joins of annotation tables: by key, by reference list, by time and by distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixed(a: DataFrame, b: DataFrame, key: list[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A join in which columns of both sides get a suffix."""
    shared = {c for c in a.columns if c in b.columns and c not in key}
    left = a.select(*[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in a.columns])
    right = b.select(*[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in b.columns])
    return left.join(right, key, how)


def in_reference(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key).distinct(), key, "left_semi")


def not_in_reference(df: DataFrame, *references: DataFrame, key: str) -> DataFrame:
    """Rows in none of the lists."""
    union = references[0].select(key)
    for r in references[1:]:
        union = union.union(r.select(key))
    return df.join(union.distinct(), key, "left_anti")


def split_by_reference(df: DataFrame, reference: DataFrame, key: str, inside: str = "val", outside: str = "train") -> DataFrame:
    """split from membership in a list; one join, nothing scanned twice."""
    marks = reference.select(key).distinct().withColumn("__in", F.lit(True))
    return df.join(marks, key, "left").withColumn("split", F.when(F.col("__in"), inside).otherwise(outside)).drop("__in")


def lookup_update(df: DataFrame, corrections: DataFrame, key: list[str], columns: Sequence[str]) -> DataFrame:
    """Listed columns overwritten where the correction sheet has the key; n_corrections tells how often it has it.

    Of several corrections the smallest values count.
    """
    sheet = corrections.groupBy(*key).agg(F.count("*").alias("n_corrections"), F.min(F.struct(*columns)).alias("__new"))
    rows = df.join(sheet, key, "left")
    updated = {c: F.coalesce(F.col(f"__new.{c}"), F.col(c)) for c in columns}
    return rows.withColumns({**updated, "n_corrections": F.coalesce("n_corrections", F.lit(0))}).drop("__new")


def missing_cells(rows: DataFrame, columns: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid of two small dimension tables that are not there."""
    return rows.crossJoin(columns).join(present.select(*keys).distinct(), keys, "left_anti")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: Sequence[str], name: str = "nearest") -> DataFrame:
    """Each left row with the right row of its keys that is nearest in time; the earlier of two as near.

    Both sides are laid out along time in one sort, and the last right row
    before and the first one after are carried to each left row: no pair of
    rows but these two is ever made.  Of right rows at one time the smallest
    counts.
    """
    value = F.struct(F.col(time).alias("time"), *[F.col(c).alias(c) for c in columns])
    a = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__right"))
    b = right.groupBy(*keys, time).agg(F.min(F.struct(*columns)).alias("__v")).select(*keys, time, F.struct(F.col(time).alias("time"), F.col("__v.*")).alias("__right"))
    both = a.unionByName(b.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(time, "__side")
    back = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("__side"))
    rows = both.withColumns(
        {
            "__before": F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "__after": F.last("__right", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("__side = 1")
    micros = lambda c: F.unix_micros(c)
    gap_before = micros(F.col(time)) - micros(F.col("__before.time"))
    gap_after = micros(F.col("__after.time")) - micros(F.col(time))
    nearer = F.when(F.col("__after").isNull() | (gap_before <= gap_after), F.col("__before")).otherwise(F.col("__after"))
    return rows.withColumn(name, nearer).drop("__side", "__right", "__before", "__after")


def once_per_match(df: DataFrame, matched: Column, order: Column) -> DataFrame:
    """One row of those that found the same match, the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(matched).orderBy(order))).where("__n = 1").drop("__n")


def within_distance(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, limit: float) -> DataFrame:
    """Pairs of rows of equal keys whose numbers ``x`` and ``y`` are at most ``limit`` apart.

    The right side is put in three neighbouring buckets of that width, so
    the join is by equality.
    """
    left = a.withColumn("__cell", F.floor(F.col(x) / limit))
    cell = F.floor(F.col(y) / limit)
    right = b.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    return left.join(right, [*keys, "__cell"]).where(F.abs(F.col(x) - F.col(y)) <= limit).drop("__cell")


def within_radius(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """Pairs of points (ax, ay) and (bx, by) at most ``limit`` apart, by a grid of that width."""
    left = a.withColumns({"__i": F.floor(F.col("ax") / limit), "__j": F.floor(F.col("ay") / limit)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.withColumn("__s", F.explode(steps)).withColumns(
        {"__i": F.floor(F.col("bx") / limit) + F.col("__s.i"), "__j": F.floor(F.col("by") / limit) + F.col("__s.j")}
    )
    gap = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return left.join(right, ["__i", "__j"]).withColumn("distance", gap).where(F.col("distance") <= limit).drop("__i", "__j", "__s")


def band(df: DataFrame, place: str, back: int, ahead: int, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (a_, b_) with b's place from a's - ``back`` to a's + ``ahead``, itself left out.

    Places are cut in buckets as wide as the band; a row meets its own bucket
    and the neighbouring ones.
    """
    width = max(1, back, ahead)
    a = df.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (place, *columns)], F.floor(F.col(place) / width).alias("__cell"))
    cell = F.floor(F.col(place) / width)
    b = df.select(*keys, *[F.col(c).alias(f"b_{c}") for c in (place, *columns)], F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    gap = F.col(f"b_{place}") - F.col(f"a_{place}")
    return a.join(b, [*keys, "__cell"]).where((gap >= -back) & (gap <= ahead) & (gap != 0)).drop("__cell")


def nearest_per_pixel(points: DataFrame, pixel: list[str], distance: str, columns: Sequence[str]) -> DataFrame:
    """For each pixel the nearest point that falls on it."""
    return points.groupBy(*pixel).agg(F.min(F.struct(distance, *columns)).alias("p")).select(*pixel, "p.*")
