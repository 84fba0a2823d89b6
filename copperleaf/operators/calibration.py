"""Isotonic calibration of predictions, head by head."""

from __future__ import annotations

import json

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predictions are fitted to so many digits: that bounds the points of a curve, whatever the rows.
DIGITS, LEAST = 4, 10


def fit(df: DataFrame, heads: dict[str, tuple[str, str, Column]]) -> dict[str, tuple[list[float], list[float]]]:
    """The curve (x, y) of each head of (prediction, target, mask) that has ten rows or more; others have none."""
    curves = {}
    for head, (p, t, mask) in heads.items():
        rows = df.filter(mask & F.col(p).isNotNull() & F.col(t).isNotNull())
        points = rows.groupBy(F.round(F.col(p).cast("double"), DIGITS).alias("x")).agg(F.avg(F.col(t).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
        if (points.agg(F.sum("w")).first()[0] or 0) < LEAST:
            continue
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(points)
        curves[head] = ([float(x) for x in model.boundaries], [min(1.0, max(0.0, float(y))) for y in model.predictions])
    return curves


def apply(prediction: Column, curve: tuple[list[float], list[float]] | None) -> Column:
    """The prediction by the curve: straight lines between its points, the ends beyond them; as it is without a curve."""
    if curve is None:
        return prediction
    x, y = curve
    if len(x) < 2:
        return F.when(prediction.isNotNull(), y[0])
    points = F.from_json(F.lit(json.dumps([{"x": a, "y": b} for a, b in zip(x, y, strict=True)])), "array<struct<x:double,y:double>>")  # one constant of the plan
    before = F.try_element_at(F.filter(points, lambda q: q["x"] <= prediction), F.lit(-1))
    after = F.get(F.filter(points, lambda q: q["x"] > prediction), F.lit(0))
    line = before["y"] + (after["y"] - before["y"]) * (prediction - before["x"]) / F.nullif(after["x"] - before["x"], F.lit(0.0))
    return F.when(prediction < x[0], y[0]).when(prediction >= x[-1], y[-1]).otherwise(line)


def calibrated(df: DataFrame, heads: dict[str, tuple[str, str, Column]], curves: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """``df`` with <head>_calibrated for every head, within 0 and 1."""
    return df.withColumns({f"{h}_calibrated": F.least(F.lit(1.0), F.greatest(F.lit(0.0), apply(F.col(p), curves.get(h)))) for h, (p, _, _) in heads.items()})


def dumps(curves: dict[str, tuple[list[float], list[float]]]) -> str:
    return json.dumps({h: {"x": x, "y": y} for h, (x, y) in curves.items()})


def loads(text: str) -> dict[str, tuple[list[float], list[float]]]:
    """Raises ValueError for a curve that does not rise, which no fit has written."""
    curves = {}
    for head, c in json.loads(text).items():
        x, y = c["x"], c["y"]
        if len(x) != len(y) or any(a >= b for a, b in zip(x, x[1:])) or any(a > b for a, b in zip(y, y[1:])):
            raise ValueError(f"no rising curve of {head}")
        curves[head] = (x, y)
    return curves
