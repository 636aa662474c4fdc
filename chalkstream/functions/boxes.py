"""Column expressions over boxes kept as four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ["x0", "y0", "x1", "y1"]


def width(p: str = "") -> Column:
    return F.col(f"{p}x1") - F.col(f"{p}x0")


def height(p: str = "") -> Column:
    return F.col(f"{p}y1") - F.col(f"{p}y0")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def center_x(p: str = "") -> Column:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2


def center_y(p: str = "") -> Column:
    return (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def union_box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
