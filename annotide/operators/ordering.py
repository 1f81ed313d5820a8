"""Row numbers, runs, quotas, samples and splits.

A place in a sorted table is a bucket of the sort key, the rows in the buckets
before, and the place in the bucket: no window spans the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.functions import geometry

#: Least and most buckets of the sort key, and rows that one bucket should hold at most.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 1024, 4_000_000


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` with __bucket: consecutive ranges of a numeric column, -1 for nulls, about as full as one another."""
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(BUCKETS, df.count() // BUCKET_ROWS))
    cuts = sorted(set(df.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.005)))
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda c: c < F.col(key).cast("double"))))
    return df.withColumn("__bucket", bucket)


def numbered(df: DataFrame, key: str, name: str = "place", buckets: int | None = None, then: Sequence[str] = ()) -> DataFrame:
    """``df`` with each row's place (from 0) in the order of a numeric column, nulls first, equal ones by ``then``.

    key and ``then`` must tell rows apart.  Cuts between buckets come from
    approximate quantiles; any cuts give the same places, good ones even work.
    """
    rows = bucketed(df, key, buckets)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__bucket", before.alias("__before"))  # a row a bucket
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(key, *then)) - 1
    return rows.withColumn("__own", own).join(F.broadcast(offsets), "__bucket").withColumn(name, F.col("__before") + F.col("__own")).drop("__bucket", "__own", "__before")


def hash_order(key: Column, seed: int = 0) -> Column:
    """A seeded pseudo-random order that any cluster repeats."""
    return F.xxhash64(key, F.lit(seed))


def split_first(df: DataFrame, order: str, share: float) -> DataFrame:
    """split = train for the first floor(n * share) rows in ``order``, else val."""
    rows = df.count()
    return numbered(df, order).withColumn("split", F.when(F.col("place") < int(rows * share + 1e-9), "train").otherwise("val")).drop("place")


def random_split(df: DataFrame, key: str, share: float, seed: int = 1010) -> DataFrame:
    """split by a seeded hash order; the sizes are exact."""
    return split_first(df.withColumn("__draw", hash_order(F.col(key), seed)), "__draw", share).drop("__draw")


def three_way_split(df: DataFrame, key: str, train: float, test: float, seed: int = 0) -> DataFrame:
    """train, test and val by two cuts of one seeded order."""
    rows = df.count()
    first, second = int(rows * train + 1e-9), int(rows * (train + test) + 1e-9)
    place = numbered(df.withColumn("__draw", hash_order(F.col(key), seed)), "__draw")
    return place.withColumn("split", F.when(F.col("place") < first, "train").when(F.col("place") < second, "test").otherwise("val")).drop("place", "__draw")


def folds(df: DataFrame, order: str, k: int, name: str = "fold") -> DataFrame:
    """k folds of consecutive rows, the remainder to the first folds."""
    rows = df.count()
    short, long_folds = divmod(rows, k)
    edge = long_folds * (short + 1)
    place = F.col("__place")
    fold = F.when(place < edge, F.floor(place / (short + 1))).otherwise(long_folds + F.floor((place - edge) / max(1, short)))
    return numbered(df, order, "__place").withColumn(name, fold.cast("int")).drop("__place")


def every(df: DataFrame, order: str, step: int, first: int = 0) -> DataFrame:
    """Every ``step``-th row in ``order``."""
    return numbered(df, order, "__place").where(F.col("__place") % step == first).drop("__place")


def interval_of(share: float, exact: bool = True) -> int:
    """The step that leaves about 1 - ``share`` of the rows; without ``exact`` the percentage is cut, not rounded."""
    percent = round((1 - share) * 100) if exact else int((1 - share) * 100)
    return 100 // max(1, percent)


def dealt(df: DataFrame, order: str, k: int, name: str = "task") -> DataFrame:
    """Rows dealt to k tasks in turn."""
    return numbered(df, order, "__place").withColumn(name, (F.col("__place") % k).cast("int")).drop("__place")


def chunks(df: DataFrame, order: str, size: int, name: str = "chunk") -> DataFrame:
    return numbered(df, order, "__place").withColumn(name, F.floor(F.col("__place") / size).cast("int")).drop("__place")


def between(df: DataFrame, order: str, low: int, high: int) -> DataFrame:
    """Rows ``low`` (from 0) up to but not including ``high``."""
    return numbered(df, order, "__place").where((F.col("__place") >= low) & (F.col("__place") < high)).drop("__place")


def without_places(df: DataFrame, order: str, places: list[int]) -> DataFrame:
    """Rows but those at listed places."""
    return numbered(df, order, "__place").where(~F.col("__place").isin(places)).drop("__place")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """At most n rows of each group, in ``order``."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")


def split_per_class(df: DataFrame, group: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """train and val of each class, floor(n * share) of it to train, in a seeded order."""
    drawn = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    size = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("split", F.when(F.row_number().over(drawn) <= F.floor(size * share), "train").otherwise("val"))


def sample_distinct(df: DataFrame, keys: list[str], order: list[Column], n: int, seed: int = 0) -> DataFrame:
    """n rows in a seeded order, of the first row of each key."""
    return first_per_group(df, keys, order).orderBy(hash_order(F.concat_ws("\u0001", *keys), seed), *keys).limit(n)


def shown_subset(images: DataFrame, boxes: DataFrame, key: str, box: str, n_images: int, n_boxes: int, seed: int = 0) -> DataFrame:
    """At most ``n_boxes`` boxes of each of ``n_images`` images, both by seeded orders."""
    few = images.orderBy(hash_order(F.col(key), seed), key).limit(n_images).select(key)
    return first_per_group(boxes.join(F.broadcast(few), key), [key], [hash_order(F.col(box), seed), F.col(box)], n_boxes)


def weighted_choice(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, each drawn by its weight: the smallest -log(u) / weight of a seeded u."""
    u = (F.pmod(hash_order(F.col(key), seed), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = df.where(F.col(weight) > 0).withColumn("__draw", -F.log(u) / F.col(weight))
    return rows.orderBy("__draw", key).limit(n).drop("__draw")


def runs(df: DataFrame, group: list[str], order: list[Column], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows in each group; a row where ``breaks`` holds opens one."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def beside_next(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the one after it."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})


def changes_to_next(df: DataFrame, group: list[str], order: list[Column], image: str, width: int) -> DataFrame:
    """Each row with measures against the image after it: shift (phase correlation), turn and mirror (similarities).

    turn is the largest similarity to the next square image turned by one, two
    or three quarters, mirror the one to it with left and right exchanged; null
    for the last row of a group.
    """
    rows = beside_next(df, group, order, [image])
    own, after = F.col(image), F.col(f"next_{image}")
    rows = rows.withColumn("__mirrored", geometry.mirrored(after, width)).withColumn("__q1", geometry.quarter_turned(after, width))
    for k in (2, 3):  # columns of their own, so that no turn is computed anew for each use
        rows = rows.withColumn(f"__q{k}", geometry.quarter_turned(F.col(f"__q{k - 1}"), width))
    like = {c: geometry.structural_similarity(own, F.col(c)) for c in ("__mirrored", "__q1", "__q2", "__q3")}
    rows = rows.withColumns({f"{c}_like": v for c, v in like.items()})
    there = after.isNotNull()
    rows = rows.withColumns(
        {
            "shift": F.when(there, geometry.phase_response(own, after, width)),
            "turn": F.when(there, F.greatest("__q1_like", "__q2_like", "__q3_like")),
            "mirror": F.when(there, F.col("__mirrored_like")),
        }
    )
    return rows.drop(f"next_{image}", *like, *[f"{c}_like" for c in like])
