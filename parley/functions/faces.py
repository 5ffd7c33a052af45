"""Boxes, landmarks and class scores of a face, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class order of the seven emotion scores and the label each class maps to.
EMOTION_OF_CLASS = ["Negative", "Negative", "Normal", "Positive", "Normal", "Normal", "Normal"]
EMOTIONS = ["Unknown", "Positive", "Normal", "Negative"]


def original_box(top, right, bottom, left, scale_w: Column, scale_h: Column, roi: Column | None = None) -> Column:
    """Box in the original resolution: shifted by the ROI origin if there is one, else rescaled and rounded.

    ``scale_*`` is analysed size / original size; ``roi`` is a struct with x and y, or NULL.
    """
    scaled = F.struct(*[F.bround(v / s).cast("int").alias(n) for n, v, s in (
        ("top", top, scale_h), ("right", right, scale_w), ("bottom", bottom, scale_h), ("left", left, scale_w))])
    if roi is None:
        return scaled
    shifted = F.struct(*[(v + roi[a]).cast("int").alias(n) for n, v, a in (
        ("top", top, "y"), ("right", right, "x"), ("bottom", bottom, "y"), ("left", left, "x"))])
    return F.when(roi.isNotNull(), shifted).otherwise(scaled)


def midpoint(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    return F.struct(((top + bottom) / 2).alias("y"), ((right + left) / 2).alias("x"))


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def mouth_aspect_ratio(top_lip: Column, bottom_lip: Column) -> Column:
    """Mean of the three vertical lip distances over the horizontal one; lips are arrays of structs with x and y."""
    pairs = ((2, 4), (3, 3), (4, 2))  # fixed values: landmark numbers facing each other
    tall = sum((_gap(top_lip[t], bottom_lip[b]) for t, b in pairs[1:]), _gap(top_lip[pairs[0][0]], bottom_lip[pairs[0][1]]))
    return tall / 3 / _gap(top_lip[0], bottom_lip[0])


def eye_centre(left_eye: Column, right_eye: Column, box_left: Column, box_top: Column) -> Column:
    """Integer midpoint between the outer extremes of both eyes, moved by the box origin."""
    xs = lambda e: F.transform(e, lambda p: p["x"])
    ys = F.transform(F.concat(left_eye, right_eye), lambda p: p["y"])
    return F.struct((box_left + F.floor((F.array_max(xs(right_eye)) + F.array_min(xs(left_eye))) / 2)).alias("x"),
                    (box_top + F.floor((F.array_min(ys) + F.array_max(ys)) / 2)).alias("y"))


def emotion(scores: Column) -> Column:
    """Label of the highest class score; the first one wins a tie."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(e) for e in EMOTION_OF_CLASS]), best)
