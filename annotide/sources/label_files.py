"""Label text files: one per image, one line per object.

Files are read whole, so the line number within a file is the object's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.functions import polygons, text
from annotide.operators import labels


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, stem, length, modified): a listing with empty files, of length 0; contents aren't read."""
    options = {"pathGlobFilter": glob, "recursiveFileLookup": recursive}
    one_slash = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = spark.createDataFrame([(p,) for p in spark.read.options(**options).text(path, wholetext=True).inputFiles()], "path string")
    known = spark.read.format("binaryFile").options(**options).load(path).select(one_slash(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    rows = names.select(one_slash(F.col("path")).alias("path")).join(known, "path", "left")
    return rows.select("path", text.basename(F.col("path")).alias("name"), text.stem(F.col("path")).alias("stem"), F.coalesce("length", F.lit(0)).alias("length"), "modified")


def lines(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file, line_no, line): lines that are not blank, numbered from 0 as they stand."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    rows = rows.select(text.stem(F.col("_metadata.file_path")).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return rows.where(F.length(F.trim("line")) > 0)


def label_rows(spark: SparkSession, path: str, attributes: bool = False, confidence: bool = False, binary: bool = False, names: DataFrame | None = None) -> DataFrame:
    """(image, obj, cls, atts, coords, conf) of label or prediction files.

    With ``confidence`` the last number is one.  ``binary`` makes levels 0 or
    1.  ``names(cls, name)`` adds the class name, null for unknown classes.
    """
    rows = rows_of(lines(spark, path), attributes, confidence, binary)
    return rows.join(F.broadcast(names), "cls", "left") if names is not None else rows


def rows_of(lines: DataFrame, attributes: bool = False, confidence: bool = False, binary: bool = False) -> DataFrame:
    """The same of ``lines(file, line_no, line)``, wherever they come from."""
    rows = lines.withColumn("p", labels.parsed(F.col("line"), attributes))
    coords = F.col("p.coords")
    return rows.select(
        F.col("file").alias("image"),
        F.col("line_no").alias("obj"),
        "p.cls",
        (labels.binarised(F.col("p.atts")) if binary else F.col("p.atts")).alias("atts"),
        (F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))) if confidence else coords).alias("coords"),
        (F.try_element_at(coords, F.lit(-1)) if confidence else F.lit(None).cast("double")).alias("conf"),
    )


def with_boxes(df: DataFrame) -> DataFrame:
    """cx, cy, w, h from four coordinates or from a polygon; zeros for a malformed one."""
    box = F.when(F.size("coords") == 4, F.col("coords")).otherwise(polygons.centre_box(F.col("coords")))
    rows = df.withColumn("__b", box)
    return rows.withColumns({n: F.get("__b", k) for k, n in enumerate(("cx", "cy", "w", "h"))}).drop("__b")


def with_empty(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of ``df`` and one row with nulls for each listed file without any."""
    return listing.select(F.col("stem").alias("image")).join(df, "image", "left")


def list_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem): a list file with one path in a line."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("path"), text.stem(F.trim("value")).alias("stem"))


def last_tokens(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """(token): the last token of each line, with an ending added."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.concat(F.element_at(F.split(F.trim("value"), r"\s+"), -1), F.lit(ending)).alias("token"))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(cls, name): the line number is the id."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("cls", "name"))
    return rows.select("cls", F.trim("name").alias("name")).where("name <> ''")


def attribute_levels(spark: SparkSession, path: str) -> DataFrame:
    """(att_idx, att, level_idx, level) of a YAML file whose attributes map names to level names."""
    import yaml

    names = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])["attributes"]
    rows = [(i, a, k, str(level)) for i, (a, levels) in enumerate(names.items()) for k, level in enumerate(levels)]
    return spark.createDataFrame(rows, "att_idx int, att string, level_idx int, level string")


def dataset_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, name): class names of data.yaml files below a folder."""
    import yaml

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            found = [(f, str(n)) for f, v in zip(pdf["file"], pdf["value"], strict=True) for n in (lambda x: x.values() if isinstance(x, dict) else x)((yaml.safe_load(v) or {}).get("names", []))]
            yield pd.DataFrame(found, columns=["file", "name"])

    rows = spark.read.option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(parse, "file string, name string")


# writing


def label_text(df: DataFrame, attributes: bool = False) -> DataFrame:
    """(image, value): the text of each image's label file, lines by object number."""
    line = labels.line_of(F.col("cls"), F.col("coords"), F.col("atts") if attributes else None)
    rows = df.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("obj", line.alias("line")))).alias("r"))
    return rows.select("image", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("value"))


def write_labels(df: DataFrame, path: str, attributes: bool = False) -> None:
    """One folder for each image with its label file."""
    label_text(df, attributes).write.partitionBy("image").text(path)


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.text(path)


def write_per_category(df: DataFrame, category: str, path: str) -> None:
    df.write.partitionBy(category).option("header", True).csv(path)


def submission(images: DataFrame, predictions: DataFrame, default: str = "") -> DataFrame:
    """(image, classes, boxes, scores): comma-joined arrays by falling confidence; a default row for images without any."""
    rows = predictions.groupBy("image").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("k"), "obj", "cls", F.concat_ws(" ", "x1", "y1", "x2", "y2").alias("box"), F.col("conf").cast("string").alias("score")))).alias("r")
    )
    joined = lambda f: F.array_join(F.transform("r", lambda r: r[f].cast("string")), ",")
    return images.select("image").join(rows, "image", "left").select("image", *[F.coalesce(joined(f), F.lit(default)).alias(n) for f, n in (("cls", "classes"), ("box", "boxes"), ("score", "scores"))])


def crop_layout(df: DataFrame, levels: Column) -> DataFrame:
    """(image, obj, att, level, file): where the crop of each object goes, for each of its attributes."""
    rows = df.select("image", "obj", F.posexplode(levels).alias("att", "level"))
    return rows.withColumn("file", F.concat_ws("/", "att", "level", F.concat_ws("_", "image", "obj")))
