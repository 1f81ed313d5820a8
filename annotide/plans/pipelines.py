"""Whole paths: label statistics, evaluation, and curation of data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.operators import joins, labels, matching, ordering, statistics, tables


def label_stats(annotations: DataFrame, images: DataFrame | None = None, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Statistics of label rows (image, cls, atts, cx, cy, w, h), of the reference images only if given."""
    rows = joins.in_reference(annotations, reference, "image") if reference is not None else annotations
    rows = rows.withColumn("att_sum", F.aggregate("atts", F.lit(0), lambda s, a: s + a))
    out = {
        "categories": statistics.category_counts(rows, "cls"),
        "objects_per_image": statistics.group_sizes(rows, "image"),
        "images_with_attributes": statistics.zero_and_positive(rows, "image", F.col("att_sum")),
        "areas": statistics.distribution(rows, F.col("w") * F.col("h")),
        "centres": statistics.density(rows, F.col("cx"), F.col("cy"), 20),
    }
    if images is not None:
        sized = rows.join(images, "image", "left").withColumns({"w_pix": F.col("w") * F.col("width"), "h_pix": F.col("h") * F.col("height")})
        out["shape_rates"] = statistics.binned(sized.where("h_pix > 0"), F.col("w_pix") / F.col("h_pix"), [0.0, 0.1, 0.2, 0.5, 0.8, 1.25, 2.0, 5.0, 10.0, 1000.0])
    return out


def evaluation(truth: DataFrame, predictions: DataFrame, least_conf: float = 0.0) -> dict[str, DataFrame]:
    """Matches, average precision, summary and image report of (image, obj, cls, x1, y1, x2, y2[, conf])."""
    found = predictions.where(F.col("conf") >= least_conf)
    shown = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    hits = matching.greedy(matching.iou_pairs(truth.select(*shown), found.select(*shown), matching.THRESHOLDS[0]))
    ap = matching.average_precision(truth, found, hits)
    return {"matches": hits, "ap": ap, "per_class": matching.map_per_class(ap), "summary": matching.map_summary(ap), "images": matching.image_report(truth, found, hits.where("threshold = 0.5"))}


def curated(parts: Sequence[DataFrame], classes: Mapping[int, int], dropped: Sequence[int], group: str, order: str) -> DataFrame:
    """Data sets joined into one: of copies one origin's smallest member stays, classes are remapped and dropped.

    ``parts`` have (image, cls, ...), ``group`` the origin that copies share
    and ``order`` what ranks them.
    """
    kept = []
    for part in parts:
        images = part.select("image", group, order).distinct()
        first = ordering.first_per_group(images, [group], [F.col(order), F.col("image")])
        kept.append(joins.in_reference(part, first, "image"))
    return tables.merged(kept, classes, dropped)


def checked(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Label lines of files that hold detections only."""
    return lines.join(labels.faulty_files(lines, files), "file", "left_anti")
