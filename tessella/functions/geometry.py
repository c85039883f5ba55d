"""Grid cells, size buckets, flips and boxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import config as C


def size_bucket(w: Column) -> Column:
    small, large = C.SIZE_EDGES
    return F.when(w < small, 0).when(w < large, 1).otherwise(2)


def cells(v: Column, grid: int) -> Column:
    """The cell of a coordinate, and its neighbour if the coordinate lies near that edge."""
    at = F.least(F.greatest(v, F.lit(0.0)), F.lit(0.999999)) * grid
    c = F.floor(at).cast("int")
    part = at - c
    near = F.when((part < C.GRID_EDGE) & (c > 0), F.array(c, c - 1)).when((part > 1 - C.GRID_EDGE) & (c < grid - 1), F.array(c, c + 1))
    return F.coalesce(near, F.array(c))


def flip(v: Column) -> Column:
    return F.round(1 - v, 4)


def flipped_label_pos(position: Column) -> Column:
    swap = {"above": "below", "below": "above", "left": "right", "right": "left"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])[position], position)


def flip_buttons(buttons: Column) -> Column:
    """An array of button structs turned by 180 degrees."""
    return F.transform(buttons, lambda b: b.withField("x", flip(b["x"])).withField("y", flip(b["y"])).withField("label_pos", flipped_label_pos(b["label_pos"])))


def percent_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Centre fractions to top-left percents."""
    return F.struct(((x - w / 2) * 100).alias("left"), ((y - h / 2) * 100).alias("top"), (w * 100).alias("width"), (h * 100).alias("height"))


def centre_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """Top-left percents to centre fractions, clamped to the crop; null if nothing of it is inside."""
    x0, y0 = F.greatest(left / 100, F.lit(0.0)), F.greatest(top / 100, F.lit(0.0))
    x1, y1 = F.least((left + width) / 100, F.lit(1.0)), F.least((top + height) / 100, F.lit(1.0))
    box = F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when((x1 > x0) & (y1 > y0), box)


def overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Area that two centred boxes share."""
    ix = F.least(ax + aw / 2, bx + bw / 2) - F.greatest(ax - aw / 2, bx - bw / 2)
    iy = F.least(ay + ah / 2, by + bh / 2) - F.greatest(ay - ah / 2, by - bh / 2)
    return F.greatest(ix, F.lit(0.0)) * F.greatest(iy, F.lit(0.0))


def plausible_transform(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the linear part ((a, b), (c, d)) has a modest scale and little shear."""
    det = F.abs(a * d - b * c)
    n0, n1 = F.sqrt(a * a + c * c), F.sqrt(b * b + d * d)
    shear = F.abs(a * b + c * d) / F.when((n0 >= 1e-9) & (n1 >= 1e-9), n0 * n1)
    fine = (det >= 1e-9) & (F.abs(F.log(det)) / 2 <= C.MAX_SCALE_DEVIATION) & (shear <= C.MAX_SHEAR)
    return F.coalesce(fine, F.lit(False))
