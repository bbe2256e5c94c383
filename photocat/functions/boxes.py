"""Normalized boxes (x, y, w, h; top-left, 0..1) as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _cols(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in ("x", "y", "w", "h")]


def iou(a: str = "", b: str = "r") -> Column:
    """Intersection over union of the boxes with these column prefixes; 0 when either is missing."""
    ax, ay, aw, ah = _cols(a)
    bx, by, bw, bh = _cols(b)
    ix = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = ix * iy
    union = aw * ah + bw * bh - inter
    missing = ax.isNull() | ay.isNull() | aw.isNull() | ah.isNull() | bx.isNull() | by.isNull() | bw.isNull() | bh.isNull()
    return F.when(missing, F.lit(0.0)).when(union > 0, inter / union).otherwise(F.lit(0.0))


def orient(orientation: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Stored box to upright box for orientation 1-8, as struct(x, y, w, h)."""
    right, bottom = 1 - x - w, 1 - y - h
    turned = {
        2: (right, y, w, h),
        3: (right, bottom, w, h),
        4: (x, bottom, w, h),
        5: (y, x, h, w),
        6: (bottom, x, h, w),
        7: (bottom, right, h, w),
        8: (y, right, h, w),
    }

    def box(t):
        return F.struct(*[v.alias(n) for n, v in zip("xywh", t)])

    out = None
    for o, t in turned.items():
        out = F.when(orientation == o, box(t)) if out is None else out.when(orientation == o, box(t))
    return out.otherwise(box((x, y, w, h)))


def unorient(orientation: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Upright box to the stored frame."""
    back = F.when(orientation == 6, 8).when(orientation == 8, 6).otherwise(orientation)
    return orient(back, x, y, w, h)


def turned(orientation: Column) -> Column:
    return F.coalesce(orientation, F.lit(1)).between(5, 8)


def region_frame(orientation: Column, applied_w: Column, applied_h: Column, width: Column, height: Column,
                 own_rotation: Column) -> Column:
    """Orientation to apply to a stored region: 1 when its declared size is closer in shape to the
    upright frame, unless the region carries a rotation of its own."""
    shape = F.log(applied_w / applied_h)
    stored = F.abs(shape - F.log(width / height))
    upright = F.abs(shape - F.log(height / width))
    usable = (applied_w > 0) & (applied_h > 0) & (width > 0) & (height > 0)
    o = F.coalesce(orientation, F.lit(1)).cast("int")
    decide = turned(orientation) & F.coalesce(usable, F.lit(False)) & ~F.coalesce(own_rotation, F.lit(False))
    return F.when(decide & (upright < stored), F.lit(1)).otherwise(o)


def dims_mismatch(orientation: Column, applied_w: Column, applied_h: Column, width: Column, height: Column) -> Column:
    """The declared size is more than 1 % off the stored size and, for a turned file, off the upright one."""

    def off(fw, fh):
        return (F.abs(applied_w - fw) / fw > 0.01) | (F.abs(applied_h - fh) / fh > 0.01)

    usable = (applied_w > 0) & (applied_h > 0) & (width > 0) & (height > 0)
    return F.coalesce(usable & off(width, height) & (~turned(orientation) | off(height, width)), F.lit(False))
