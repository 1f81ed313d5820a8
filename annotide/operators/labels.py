"""Filters, remaps and rewrites of label rows.

Label rows have a class ``cls``, an array ``atts`` of attribute levels and
``coords`` (four numbers of a box, or a polygon).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.functions import polygons


def mapping(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parsed(line: Column, attributes: bool) -> Column:
    """A label line as struct cls, atts, coords; without attributes the second token is a coordinate."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    numbers = lambda a, kind: F.transform(a, lambda v: v.cast("double").cast(kind))
    count = F.get(parts, 1).cast("double").cast("int") if attributes else F.lit(0)
    skip = count + 2 if attributes else F.lit(1)
    return F.struct(
        F.get(parts, 0).cast("double").cast("int").alias("cls"),
        (numbers(F.slice(parts, 3, count), "int") if attributes else F.array().cast("array<int>")).alias("atts"),
        numbers(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), "double").alias("coords"),
    )


def number_text(value: Column) -> Column:
    """Up to six decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""), r"\.$", "")


def line_of(cls: Column, coords: Column, atts: Column | None = None) -> Column:
    """The label line of a row; with ``atts`` their number and levels stand before the coordinates."""
    tail = F.array_join(F.transform(coords, number_text), " ")
    if atts is None:
        return F.concat_ws(" ", cls.cast("string"), tail)
    levels = F.array_join(F.transform(atts, lambda a: a.cast("string")), " ")
    return F.concat_ws(" ", cls.cast("string"), F.size(atts).cast("string"), F.when(F.size(atts) > 0, levels), tail)


# classes


def shift_class(df: DataFrame, by: int, keep: Sequence[int] = (), column: str = "cls") -> DataFrame:
    """Class ids moved by ``by``, but for those in ``keep``."""
    moved = F.col(column) + by
    return df.withColumn(column, F.when(F.col(column).isin(list(keep)), F.col(column)).otherwise(moved) if keep else moved)


def remap_class(df: DataFrame, pairs: Mapping, column: str = "cls", drop_unknown: bool = False) -> DataFrame:
    new = F.try_element_at(mapping(pairs), F.col(column))
    out = df.withColumn(column, new if drop_unknown else F.coalesce(new, F.col(column)))
    return out.where(F.col(column).isNotNull()) if drop_unknown else out


def remap_by_names(df: DataFrame, old: Sequence[str], new: Sequence[str], column: str = "cls") -> DataFrame:
    """Ids of one order of names to those of another; names that are gone stay as they are."""
    return remap_class(df, {k: new.index(n) for k, n in enumerate(old) if n in new}, column)


def without_classes(df: DataFrame, classes: Sequence, column: str = "cls") -> DataFrame:
    return df.where(~F.col(column).isin(list(classes)))


def with_classes(df: DataFrame, classes: Sequence, column: str = "cls") -> DataFrame:
    return df.where(F.col(column).isin(list(classes)))


def class_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """Dense ids of the sorted distinct names, from 0."""
    return names.select(column).distinct().withColumn("cls", (F.row_number().over(Window.orderBy(column)) - 1))


def with_second_above(df: DataFrame, least: float = 1.0, line: str = "line") -> DataFrame:
    """Lines whose second token is above ``least``: it counts attributes there, and is a coordinate elsewhere."""
    return df.where(F.get(F.split(F.trim(F.col(line)), r"\s+"), 1).cast("double") > least)


def centres_inside(df: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows whose centre is inside the frame, classes moved up by one."""
    return shift_class(df.where((F.col("cx") <= most) & (F.col("cy") <= most)), 1)


def without_confidence(df: DataFrame, column: str = "conf") -> DataFrame:
    return df.drop(column)


def with_confidence(df: DataFrame, value: float = 1.0, column: str = "conf") -> DataFrame:
    return df.withColumn(column, F.lit(value))


# attributes


def without_negative(df: DataFrame) -> DataFrame:
    """Attributes that are negative in any row are dropped from all rows."""
    size = df.select(F.max(F.size("atts")).alias("n")).first()["n"] or 0
    lows = df.select(F.posexplode("atts").alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"))
    gone = sorted(r["i"] for r in lows.where("low < 0").collect())  # a number for each attribute at most
    return df.withColumn("atts", F.filter("atts", lambda _, i: ~i.isin(gone))) if gone and size else df


def zero_attributes(df: DataFrame, cls: int, count: int) -> DataFrame:
    return df.withColumn("atts", F.when(F.col("cls") == cls, F.array_repeat(F.lit(0), count)).otherwise(F.col("atts")))


def drop_attributes(df: DataFrame) -> DataFrame:
    return df.withColumn("atts", F.array().cast("array<int>"))


def insert_attributes(df: DataFrame, count: int, flagged: DataFrame, key: str) -> DataFrame:
    """A block of zeros for objects of the flagged files."""
    marks = flagged.select(key).distinct().withColumn("__flag", F.lit(True))
    zeros = F.array_repeat(F.lit(0), count)
    return df.join(marks, key, "left").withColumn("atts", F.when(F.col("__flag"), zeros).otherwise(F.col("atts"))).drop("__flag")


def set_level(df: DataFrame, index: int, old: int, new: int) -> DataFrame:
    changed = F.transform("atts", lambda v, i: F.when((i == index) & (v == old), F.lit(new)).otherwise(v))
    return df.withColumn("atts", changed)


def merge_attributes(df: DataFrame, pairs: Mapping[int, int], removed: Sequence[int] = ()) -> DataFrame:
    """The larger of attributes k and v stands at v; k and the removed ones go."""
    gone = [*pairs, *removed]
    merged = F.transform(
        "atts",
        lambda v, i: F.greatest(v, *[F.when(i == new, F.get(F.col("atts"), F.lit(old))).otherwise(v) for old, new in pairs.items()]) if pairs else v,
    )
    return df.withColumn("atts", F.filter(merged, lambda v, i: ~i.isin(gone)) if gone else merged)


def binarised(atts: Column) -> Column:
    return F.transform(atts, lambda a: (a > 0).cast("int"))


def any_attribute(atts: Column) -> Column:
    return F.exists(atts, lambda a: a != 0)


def any_at_level(atts: Column, level: int) -> Column:
    return F.exists(atts, lambda a: a == level)


def level_names(atts: Column, names: Sequence[Sequence[str]]) -> Column:
    """The name of each attribute's level."""
    table = F.array(*[F.array(*[F.lit(n) for n in own]) for own in names])
    return F.transform(atts, lambda a, i: F.get(F.get(table, i), a))


def one_hot(levels: Column, order: Sequence[str]) -> Column:
    """A map attribute -> level as an array in the order of names; 0 for those not there."""
    return F.array(*[F.coalesce(F.try_element_at(levels, F.lit(n)), F.lit(0)) for n in order])


def truthy(levels: Column) -> Column:
    """Names of the set attributes as struct text, n."""
    names = F.array_sort(F.map_keys(F.map_filter(levels, lambda _, v: v != 0)))
    return F.struct(F.array_join(names, ", ").alias("text"), F.size(names).alias("n"))


# nested attribute maps of shapes


def without_key(shapes: Column, key: str) -> Column:
    """Shapes without one attribute; the array has structs with a map ``attributes``."""
    return F.transform(shapes, lambda s: s.withField("attributes", F.map_filter(s["attributes"], lambda k, _: k != key)))


def with_values(shapes: Column, key: str, values: Mapping[str, str]) -> Column:
    """One attribute's values rewritten."""
    table = mapping(values)
    return F.transform(
        shapes,
        lambda s: s.withField(
            "attributes", F.transform_values(s["attributes"], lambda k, v: F.when(k == key, F.coalesce(F.try_element_at(table, v), v)).otherwise(v))
        ),
    )


def translated(shapes: Column, labels: Mapping[str, str], keys: Mapping[str, str], values: Mapping[str, str]) -> Column:
    """Labels, attribute names and attribute values through dictionaries; unknown ones stay."""
    tables = [mapping(m or {"": ""}) for m in (labels, keys, values)]
    put = lambda table, x: F.coalesce(F.try_element_at(table, x), x)

    def one(s: Column) -> Column:
        renamed = F.transform_keys(s["attributes"], lambda k, _: put(tables[1], k))
        return s.withField("label", put(tables[0], s["label"])).withField("attributes", F.transform_values(renamed, lambda _, v: put(tables[2], v)))

    return F.transform(shapes, one)


def attribute_values(df: DataFrame, shapes: str = "shapes") -> DataFrame:
    """(label, attribute, value, first): distinct values and the first place they are seen."""
    rows = df.select(F.col("file"), F.posexplode(shapes).alias("at", "s"))
    rows = rows.select("file", "at", F.col("s.label").alias("label"), F.explode("s.attributes").alias("attribute", "value"))
    return rows.groupBy("label", "attribute", "value").agg(F.min(F.struct("file", "at")).alias("first"))


# checks and selections


def keep_large(df: DataFrame, least: float, classes: Sequence[int] | None = None) -> DataFrame:
    """Rows whose box area reaches ``least``; classes not listed pass.  Adds poly_area and box_area."""
    rows = df.withColumns({"poly_area": polygons.area(F.col("coords")), "box_area": polygons.box_area(F.col("coords"))})
    large = F.col("box_area") >= least
    return rows.where(large if classes is None else large | ~F.col("cls").isin(list(classes)))


def task_of(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, task): det if the first line that isn't empty has five tokens, else seg."""
    rows = lines.where(F.length(F.trim("line")) > 0)
    size = F.size(F.split(F.trim("line"), r"\s+"))
    return rows.groupBy(file).agg(F.min_by(size, "line_no").alias("n")).select(file, F.when(F.col("n") == 5, "det").otherwise("seg").alias("task"))


def faulty_files(lines: DataFrame, files: DataFrame, columns: int = 5, file: str = "file") -> DataFrame:
    """Files that are empty or have a line of another number of tokens."""
    size = F.size(F.split(F.trim("line"), r"\s+"))
    good = lines.where(F.length(F.trim("line")) > 0).groupBy(file).agg(F.bool_and(size == columns).alias("good")).where("good")
    return files.select(file).distinct().join(good, file, "left_anti")


def empty_boxes(df: DataFrame) -> DataFrame:
    """Rows without zero width or height."""
    return df.where((F.col("w") != 0) & (F.col("h") != 0))


def severity(df: DataFrame, group: list[str], size: Column, small: float = 0.1) -> DataFrame:
    """serious: over two objects, or a large one; moderate: two small ones; slight: one small one."""
    rows = df.groupBy(*group).agg(F.count("*").alias("n"), F.max(size).alias("largest"))
    small_ones = F.col("largest") < small
    return rows.withColumn(
        "severity", F.when((F.col("n") == 2) & small_ones, "moderate").when((F.col("n") == 1) & small_ones, "slight").otherwise("serious")
    )


def rebased_frames(df: DataFrame, file: str = "file", frame: str = "frame") -> DataFrame:
    """Frames of a file that begins after 1 moved to begin at 0; others stay."""
    first = F.min(frame).over(Window.partitionBy(file))
    return df.withColumn(frame, F.when(first > 1, F.col(frame) - first).otherwise(F.col(frame)))


def review_difference(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Both reviews side by side (_x, _y) and whether any listed column differs; two nulls are equal."""
    left = a.select(key, *[F.col(c).alias(f"{c}_x") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}_y") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_x").eqNullSafe(F.col(f"{c}_y"))
    return left.join(right, key).withColumn("different", ~same)


def pseudo_labels(df: DataFrame, least: float = 0.7, file: str = "file") -> DataFrame:
    """Rows of files that have a confident object with a defect, without the confidence."""
    chosen = df.where((F.col("conf") >= least) & any_attribute(F.col("atts"))).select(file).distinct()
    return df.join(chosen, file, "left_semi").drop("conf")


def chosen_images(images: DataFrame, annotations: DataFrame, names: Sequence[str] = (), classes: Sequence[int] = ()) -> DataFrame:
    """Images by name and by a class they hold; an empty list means all."""
    rows = images.where(F.col("file_name").isin(list(names))) if names else images
    return rows.join(annotations.where(F.col("category_id").isin(list(classes))).withColumnRenamed("image_id", "id"), "id", "left_semi") if classes else rows


def near_point(points: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """3-D points within a radius."""
    square = sum(((F.col(n) - c) * (F.col(n) - c) for n, c in zip("xyz", centre, strict=True)), F.lit(0.0))
    return points.where(F.sqrt(square) < radius)
