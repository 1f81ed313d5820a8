"""Counts, distributions and matrices over annotation tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.operators import ordering


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).orderBy(category)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(size, n): how many groups have so many rows."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def binned(df: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, n): bins closed on the right, the first one on both sides; empty bins too."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("__v")))
    place = F.when(F.col("__v") == float(edges[0]), 0).otherwise(below - 1)
    counts = df.select(value.cast("double").alias("__v")).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def totals_with_all(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """Sums by category and a row named total."""
    rows = df.rollup(category).agg(*[F.sum(c).cast("long").alias(c) for c in columns], F.grouping(category).alias("__all"))
    return rows.withColumn(category, F.when(F.col("__all") == 1, "total").otherwise(F.col(category))).drop("__all")


def zero_and_positive(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """One row (groups, zero, positive): groups whose flags sum to nothing or something."""
    sums = df.groupBy(group).agg(F.sum(flag.cast("long")).alias("s"))
    return sums.agg(F.count("*").alias("groups"), F.count_if(F.col("s") == 0).alias("zero"), F.count_if(F.col("s") > 0).alias("positive"))


def rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, total, rate): sum and mean of each column, in one pass."""
    sums = df.agg(*[F.struct(F.sum(F.col(c).cast("long")).alias("total"), F.avg(F.col(c).cast("double")).alias("rate")).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("attribute"), F.col(f"{c}.total").alias("total"), F.col(f"{c}.rate").alias("rate")) for c in columns]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def cooccurrence(df: DataFrame, columns: Sequence[str], background: bool = True) -> DataFrame:
    """(i, j, v): the mean product of each two columns; without ``background`` over rows with any of them.

    All products are summed in one pass; the result has a row for each pair of columns.
    """
    rows = df if background else df.where(sum((F.col(c) for c in columns), F.lit(0)) > 0)
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}\u0001{b}") for a in columns for b in columns], F.count("*").alias("__n"))
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.try_divide(F.col(f"{a}\u0001{b}"), F.col("__n")).alias("v")) for a in columns for b in columns])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def by_diagonal(matrix: DataFrame) -> DataFrame:
    """Each row by its diagonal element; null where that is 0."""
    own = matrix.where("i = j").select("i", F.col("v").alias("d"))
    return matrix.join(F.broadcast(own), "i").select("i", "j", F.try_divide("v", "d").alias("v"))


def symmetric(matrix: DataFrame) -> DataFrame:
    """Half the sum of the matrix and its transpose."""
    return matrix.union(transposed(matrix)).groupBy("i", "j").agg((F.sum("v") / 2).alias("v"))


def cosine_normalised(matrix: DataFrame) -> DataFrame:
    own = matrix.where("i = j").select("i", F.col("v").alias("d"))
    rows = matrix.join(F.broadcast(own), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("d").alias("e"))), "j")
    return rows.select("i", "j", F.try_divide("v", F.sqrt(F.col("d") * F.col("e"))).alias("v"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def distribution(df: DataFrame, value: Column, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, population moments, extremes and sum; kurtosis in excess of the normal one's."""
    v = F.col("__v")
    return (
        df.select(*group, value.cast("double").alias("__v"))
        .groupBy(*group)
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.median(v).alias("median"),
            F.stddev_pop(v).alias("std"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.sum(v).alias("total"),
            F.var_pop(v).alias("variance"),
            F.skewness(v).alias("skew"),
            F.kurtosis(v).alias("kurtosis"),
        )
    )


def auto_histogram(df: DataFrame, value: Column) -> DataFrame:
    """(bin, low, high, n): equal bins, as many as the larger of Sturges' and Freedman-Diaconis' rules ask for."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    s = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    span, width = s["hi"] - s["lo"], 2 * (s["q3"] - s["q1"]) / s["n"] ** (1 / 3)
    bins = max(math.ceil(math.log2(s["n"])) + 1, math.ceil(span / width) if width else 1, 1)
    step = span / bins if span else 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - s["lo"]) / step)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (s["lo"] + F.col("bin") * step).alias("low"), (s["lo"] + (F.col("bin") + 1) * step).alias("high"), "n")


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """(value, share): the part of rows at or below each value; nulls don't count.

    Equal values are one row before any sort, and ranges of values are sorted
    side by side.
    """
    counts = ordering.bucketed(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value)
    sums = counts.groupBy("__bucket").agg(F.sum("n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__bucket", before.alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__all"))  # a row a bucket
    so_far = F.sum("n").over(Window.partitionBy("__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("__own", so_far).join(F.broadcast(offsets), "__bucket")
    return rows.select(F.col(value).alias("value"), ((F.col("__before") + F.col("__own")) / F.col("__all")).alias("share"))


def density(df: DataFrame, x: Column, y: Column, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bx, by, n): a 2-D histogram."""
    at = lambda v: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * bins))).cast("int")
    return df.groupBy(at(x).alias("bx"), at(y).alias("by")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, value: str, thresholds: Sequence[float], key: str, flags: dict[str, Column]) -> DataFrame:
    """(threshold, n, n_keys, flags...): counts of the rows at or above each threshold, all in one pass over the table."""
    levels = F.array(*[F.lit(t) for t in thresholds])
    rows = df.select(value, key, *[c.cast("int").alias(n) for n, c in flags.items()]).withColumn("threshold", F.explode(F.filter(levels, lambda t: t <= F.col(value))))
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), *[F.sum(n).cast("long").alias(n) for n in flags])


def registry(df: DataFrame, dataset: list[str], image: str, pivot: str, values: Sequence[str]) -> DataFrame:
    """A row for each data set: rows, images, and rows by split."""
    totals = df.groupBy(*dataset).agg(F.count("*").alias("n_rows"), F.countDistinct(image).alias("n_images"))
    splits = df.groupBy(*dataset).pivot(pivot, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return totals.join(splits, dataset)


def kept_and_dropped(df: DataFrame, dataset: str, dropped: Column) -> DataFrame:
    """Rows kept and dropped by data set, and for all."""
    return (
        df.rollup(dataset)
        .agg(F.count_if(~dropped).alias("kept"), F.count_if(dropped).alias("dropped"), F.grouping(dataset).alias("__all"))
        .withColumn(dataset, F.when(F.col("__all") == 1, "all").otherwise(F.col(dataset)))
        .drop("__all")
    )


def inverted(df: DataFrame, value: str, key: str) -> DataFrame:
    """(value, keys): the sorted keys of each value."""
    return df.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def extremes(df: DataFrame, group: Sequence[str], value: str, place: Sequence[str]) -> DataFrame:
    """Smallest and largest value and the first place of each."""
    rows = df.groupBy(*group).agg(F.min(F.struct(value, *place)).alias("low"), F.min(F.struct((-F.col(value)).alias("neg"), *place)).alias("high"))
    return rows.select(*group, F.col(f"low.{value}").alias("low"), *[F.col(f"low.{p}").alias(f"low_{p}") for p in place], (-F.col("high.neg")).alias("high"), *[F.col(f"high.{p}").alias(f"high_{p}") for p in place])


def smoothed(df: DataFrame, group: list[str], order: str, value: str, sigma: float = 3.0) -> DataFrame:
    """A Gaussian-weighted mean over the neighbouring rows, four deviations each way."""
    reach = int(4 * sigma + 0.5)
    window = Window.partitionBy(*group).orderBy(order)
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).over(window.rowsBetween(-reach, reach))
    place = F.row_number().over(window)
    rows = df.withColumns({"__k": place, "__near": near})
    first = F.greatest(F.lit(1), F.col("__k") - reach)
    weight = lambda i: F.exp(-F.pow(first + i - F.col("__k"), 2) / (2 * sigma * sigma))
    weights = F.transform("__near", lambda x, i: weight(i))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    summed = F.aggregate(F.zip_with("__near", weights, lambda x, w: x["v"] * w), F.lit(0.0), lambda s, w: s + w)
    return rows.withColumn("smooth", summed / total).drop("__k", "__near")
