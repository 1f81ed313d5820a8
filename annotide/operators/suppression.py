"""Kernels that go through the boxes of one image in order.

An image's boxes are few; images are many and run side by side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.operators.groups import by_group


def _overlap(box: np.ndarray, others: np.ndarray, metric: str, pixel: float) -> np.ndarray:
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0]) + pixel
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1]) + pixel
    common = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda b: (b[..., 2] - b[..., 0] + pixel) * (b[..., 3] - b[..., 1] + pixel)
    below = np.minimum(size(box), size(others)) if metric == "ios" else size(box) + size(others) - common
    return common / np.maximum(below, 1e-12)


def survivors(boxes: np.ndarray, scores: np.ndarray, least: float, metric: str = "iou", pixel: float = 1.0) -> np.ndarray:
    """Marks the boxes that no better one overlaps by ``least`` or more; of equal scores the first is better."""
    keep = np.zeros(len(boxes), bool)
    gone = np.zeros(len(boxes), bool)
    for k in np.argsort(-scores, kind="stable"):
        if gone[k]:
            continue
        keep[k] = True
        gone |= _overlap(boxes[k], boxes, metric, pixel) >= least
    return keep


def _box(group: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([group[c] for c in ("x1", "y1", "x2", "y2")], 1).astype(float)


def suppressed(df: DataFrame, least: float = 0.5, metric: str = "iou", per_class: bool = True) -> DataFrame:
    """Rows that survive non-maximum suppression in their image (and class), in the order of obj."""

    def one(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keep = survivors(_box(group), group["conf"], least, metric)
        return {n: c[keep] for n, c in group.items()}

    return by_group(df, ["image", "cls"] if per_class else ["image"], one, df.schema, ["obj"])


def merged_by_score(df: DataFrame, least: float = 0.5, mode: str = "intersection", per_class: bool = True) -> DataFrame:
    """Boxes taken by falling score; those whose common part is more than ``least`` of their own area join the taken box.

    Width and height count both edge pixels, one more than the difference.
    ``mode`` keeps the common part or the envelope.  The result has the taken
    box's other columns.
    """

    def one(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.argsort(-group["conf"], kind="stable")
        box = _box(group)[order]
        own = (box[:, 2] - box[:, 0] + 1) * (box[:, 3] - box[:, 1] + 1)
        free = np.ones(len(box), bool)
        taken, shapes = [], []
        for k in range(len(box)):
            if not free[k]:
                continue
            free[k] = False
            now = box[k].copy()
            for j in np.flatnonzero(free):
                w = max(0.0, min(now[2], box[j, 2]) - max(now[0], box[j, 0]) + 1)
                h = max(0.0, min(now[3], box[j, 3]) - max(now[1], box[j, 1]) + 1)
                if own[j] > 0 and w * h / own[j] > least:
                    free[j] = False
                    outer, inner = (np.maximum, np.minimum) if mode == "intersection" else (np.minimum, np.maximum)
                    now = np.r_[outer(now[:2], box[j, :2]), inner(now[2:], box[j, 2:])]
            taken.append(order[k])
            shapes.append(now)
        out = {n: c[taken] for n, c in group.items()}
        return out | dict(zip(("x1", "y1", "x2", "y2"), np.array(shapes).reshape(-1, 4).T, strict=True))

    return by_group(df, ["image", "cls"] if per_class else ["image"], one, df.schema, ["obj"])


def connected(df: DataFrame, per_class: bool = True) -> DataFrame:
    """(image, cls, x1, y1, x2, y2, n): the envelopes of boxes that touch, directly or through others.

    One pass: an envelope that meets another one stays as it is.  Without
    ``per_class`` cls is the smallest class of the group.
    """

    def one(group: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        box = _box(group)
        root = np.arange(len(box))
        for k in range(len(box)):
            meets = (box[:, 0] <= box[k, 2]) & (box[:, 2] >= box[k, 0]) & (box[:, 1] <= box[k, 3]) & (box[:, 3] >= box[k, 1])
            roots = np.unique(root[meets])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        _, part = np.unique(root, return_inverse=True)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        low, high = np.minimum.reduceat(box[order], first), np.maximum.reduceat(box[order], first)
        return {
            "image": np.repeat(group["image"][:1], len(first)),
            "cls": np.minimum.reduceat(group["cls"][order], first),
            "x1": low[:, 0],
            "y1": low[:, 1],
            "x2": high[:, 2],
            "y2": high[:, 3],
            "n": np.diff(np.append(first, len(box))),
        }

    rows = df.select(F.col("image").cast("long").alias("image"), F.col("cls").cast("long").alias("cls"), "x1", "y1", "x2", "y2")
    return by_group(rows, ["image", "cls"] if per_class else ["image"], one, "image long, cls long, x1 double, y1 double, x2 double, y2 double, n long")
