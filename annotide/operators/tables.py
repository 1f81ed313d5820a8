"""Unions, differences, merges, tiles and duplicates of data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.functions import boxes, geometry, polygons, text
from annotide.operators import joins, labels


def union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_with_offsets(tables: Sequence[DataFrame], gaps: Mapping[str, int]) -> DataFrame:
    """A union in which the ids of table k grow by k times their gap, so those of different tables stay apart."""
    moved = [t.withColumns({c: F.col(c) + k * gap for c, gap in gaps.items()}) for k, t in enumerate(tables)]
    return union(*[t.withColumn("part", F.lit(k)) for k, t in enumerate(moved)])


def overflowing(tables: Sequence[DataFrame], column: str, gap: int) -> DataFrame:
    """(part, highest) of the tables whose ids reach the gap, which a merge would mix up."""
    tops = [t.agg(F.max(column).alias("highest")).withColumn("part", F.lit(k)) for k, t in enumerate(tables)]
    return union(*tops).where(F.col("highest") >= gap)


def merged(tables: Sequence[DataFrame], classes: Mapping[int, int], dropped: Sequence[int], image: str = "image") -> DataFrame:
    """Data sets joined: classes remapped, dropped ones left out, image names kept apart by their data set."""
    named = [t.withColumn(image, F.concat(F.lit(f"{k}_"), F.col(image).cast("string"))) for k, t in enumerate(tables)]
    return labels.without_classes(labels.remap_class(union(*named), classes), dropped)


def difference_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def collisions(df: DataFrame, name: str) -> DataFrame:
    """Names that come more than once."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def without_images(images: DataFrame, annotations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the images listed in ``gone(id)``."""
    return images.join(gone, "id", "left_anti"), annotations.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti")


# duplicates


def copies_marked(df: DataFrame, group: list[str], order: list[Column], flag: str = "copy") -> DataFrame:
    """``flag`` for all rows of a group but the first in ``order``."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) > 1)


def first_of_group(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """(group, kept, n): the member of the smallest value, then key."""
    rows = df.groupBy(*group).agg(F.min(F.struct(value, key)).alias("first"), F.count("*").alias("n"))
    return rows.select(*group, F.col(f"first.{key}").alias("kept"), "n")


def equal_content(df: DataFrame, content: str) -> Column:
    """A key that equal contents share."""
    return F.sha2(F.col(content), 256)


def similar_neighbours(df: DataFrame, place: str, vector: str, back: int, ahead: int, keys: Sequence[str] = ()) -> DataFrame:
    """(a, b, similarity) of rows within a band of places."""
    pairs = joins.band(df, place, back, ahead, [vector], keys)
    return pairs.select(*keys, F.col(f"a_{place}").alias("a"), F.col(f"b_{place}").alias("b"), geometry.cosine(F.col(f"a_{vector}"), F.col(f"b_{vector}")).alias("similarity"))


def unlike_neighbours(df: DataFrame, place: str, vector: str, reach: int, most: float, keep_first: bool = False) -> DataFrame:
    """Rows whose largest similarity within ``reach`` places is at most ``most``.

    Both of two similar rows go; with ``keep_first`` only the later one.
    """
    pairs = similar_neighbours(df, place, vector, reach, 0 if keep_first else reach)
    alike = pairs.where(F.col("similarity") > most).select(F.col("a").alias(place)).distinct()
    return df.join(alike, place, "left_anti")


def near_ahead(df: DataFrame, place: str, vector: str, reach: int, limit: float) -> DataFrame:
    """(a, b, distance) of rows at most ``reach`` - 1 places ahead and less than ``limit`` apart."""
    pairs = joins.band(df, place, 0, reach - 1, [vector])
    gap = geometry.distance(F.col(f"a_{vector}"), F.col(f"b_{vector}"))
    return pairs.select(F.col(f"a_{place}").alias("a"), F.col(f"b_{place}").alias("b"), gap.alias("distance")).where(F.col("distance") < limit)


def same_origin_pairs(df: DataFrame, keys: list[str], dataset: str, name: str) -> DataFrame:
    """Pairs of rows of different data sets that share ``keys``, each once."""
    a = df.select(*keys, F.col(dataset).alias("a_set"), F.col(name).alias("a"))
    b = df.select(*keys, F.col(dataset).alias("b_set"), F.col(name).alias("b"))
    return a.join(b, keys).where("a_set < b_set")


# tiles


def tiles(width: int, height: int, tile_w: int, tile_h: int, overlap: float) -> list[tuple[int, int, int, int]]:
    """Corners of the tiles that cover a frame; those beyond the border are moved inward.

    Neighbours share the whole pixels of ``overlap`` times the tile's extent.
    """
    out = []
    step_w, step_h = max(1, tile_w - int(tile_w * overlap)), max(1, tile_h - int(tile_h * overlap))
    y = 0
    while True:
        y2 = min(y + tile_h, height)
        x = 0
        while True:
            x2 = min(x + tile_w, width)
            out.append((max(0, x2 - tile_w), max(0, y2 - tile_h), x2, y2))
            if x2 >= width:
                break
            x += step_w
        if y2 >= height:
            return out
        y += step_h


def tiled_polygons(df: DataFrame, grid: Sequence[tuple[int, int, int, int]], polygon: str = "coords") -> DataFrame:
    """Each polygon in each tile that it overlaps: a row for each part that the tile cuts it into, moved to the tile.

    Adds tile, part (from 0) and the part's ``polygon`` in pixels of the tile.
    """
    shapes = F.array(*[F.struct(F.lit(k).alias("tile"), *[F.lit(float(v)).alias(n) for n, v in zip(("tx1", "ty1", "tx2", "ty2"), t, strict=True)]) for k, t in enumerate(grid)])
    inside = F.filter(shapes, lambda t: boxes.overlaps(polygons.corners(F.col(polygon)), (t["tx1"], t["ty1"], t["tx2"], t["ty2"])))
    rows = df.withColumn("__t", F.explode(inside))
    parts = polygons.clipped_parts(F.col(polygon), *[F.col(f"__t.{n}") for n in ("tx1", "ty1", "tx2", "ty2")])
    rows = rows.select(*[c for c in df.columns if c != polygon], "__t", F.posexplode(parts).alias("part", "__p"))
    return rows.withColumns({"tile": F.col("__t.tile"), polygon: polygons.moved(F.col("__p"), -F.col("__t.tx1"), -F.col("__t.ty1"))}).drop("__t", "__p")


def sliced_names(rows: DataFrame, path: str, parts: int = 3) -> DataFrame:
    """Each listed path once for each of its slices: slice (from 0) and ``stem_slice.suffix`` in the same folder."""
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    p = F.col(path)
    name = F.concat(text.stem(p), F.lit("_"), F.col("slice").cast("string"), text.suffix(p))
    return rows.withColumn("sliced", F.when(text.folder(p) == "", name).otherwise(F.concat(text.folder(p), F.lit("/"), name)))


def verified_pairs(pairs: DataFrame, content: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose contents' structural similarity is above ``least``, with the similarity."""
    sides = [content.select(F.col(key).alias(side), F.col(vector).alias(f"__{side}")) for side in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("similarity", geometry.structural_similarity(F.col("__a"), F.col("__b")))
    return rows.where(F.col("similarity") > least).drop("__a", "__b")


def copy_plan(table: DataFrame, listing: DataFrame, name: str, target: str) -> DataFrame:
    """(source, target): which listed file goes where for each name of a table; names without a file are left out."""
    wanted = table.select(F.col(name).alias("__stem")).distinct()
    rows = listing.join(wanted, text.stem(F.col("path")) == F.col("__stem"))
    return rows.select(F.col("path").alias("source"), F.concat(F.lit(f"{target}/"), text.basename(F.col("path"))).alias("target"))


def count_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n_a, n_b, equal): rows of two tables by key, keys of either side."""
    one, other = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((a, "n_a"), (b, "n_b")))
    return one.join(other, key, "full").na.fill(0, ["n_a", "n_b"]).withColumn("equal", F.col("n_a") == F.col("n_b"))


def tiled(df: DataFrame, grid: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """Each box in each tile that it overlaps: tile number, tile corners and the box in centre form of the tile."""
    shapes = F.array(*[F.struct(F.lit(k).alias("tile"), *[F.lit(float(v)).alias(n) for n, v in zip(("tx1", "ty1", "tx2", "ty2"), t, strict=True)]) for k, t in enumerate(grid)])
    own = boxes.columns("", "x1 y1 x2 y2")
    inside = F.filter(shapes, lambda t: boxes.overlaps(own, (t["tx1"], t["ty1"], t["tx2"], t["ty2"])))
    rows = df.withColumn("__t", F.explode(inside)).select(*df.columns, "__t.*")
    cx, cy, w, h = boxes.relative(own, boxes.columns("", "tx1 ty1 tx2 ty2"))
    return rows.withColumns({"tcx": cx, "tcy": cy, "tw": w, "th": h})
