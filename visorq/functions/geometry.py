"""Box geometry, decoding and losses as pure column expressions. Boxes are center x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def iou_corners(a, b, eps: float = 1e-6) -> Column:
    """Intersection over union of corner boxes; eps keeps empty unions defined."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = iw * ih
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (area(a) + area(b) - inter + F.lit(eps))


def ciou_loss(a, b, eps: float = 1e-7) -> Column:
    """1 - iou + center distance over the enclosing diagonal + aspect-ratio penalty."""
    iou = iou_corners(a, b, eps)
    cw, ch = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    c2 = cw * cw + ch * ch + F.lit(eps)
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    angle = lambda x: F.atan((x[2] - x[0]) / (x[3] - x[1] + F.lit(eps)))
    v = F.pow(angle(b) - angle(a), 2) * F.lit(4 / 3.141592653589793**2)
    return 1 - iou + (dx * dx + dy * dy) / c2 + v * v / (1 - iou + v + F.lit(eps))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log(1 + F.exp(-F.abs(x)))


def softmax_expectation(logits: Column) -> Column:
    """Expected bin of a softmax over the array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return weighted / (total + F.lit(1e-9))


def dfl_loss(logits: Column, target: Column, bins: int = 16) -> Column:
    """Cross entropy of the two bins around the target, by their nearness."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), target))
    low = F.floor(t).cast("int")
    high = F.least(low + 1, F.lit(bins - 1))
    top = F.array_max(logits)
    logsum = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) + top
    return (logsum - F.get(logits, low)) * (low + 1 - t) + (logsum - F.get(logits, high)) * (t - low)


def letterbox(w: Column, h: Column, tw: int = 640, th: int = 640, train: bool = False) -> dict[str, Column]:
    """scale, new size and paddings; inference rounds the new size, training truncates it."""
    scale = F.least(F.lit(float(tw)) / w, F.lit(float(th)) / h)
    fit = (lambda x: x.cast("int")) if train else (lambda x: F.round(x).cast("int"))
    nw, nh = fit(w * scale), fit(h * scale)
    pad = lambda t, n: F.floor((F.lit(t) - n) / 2).cast("int")
    return {"scale": scale, "new_w": nw, "new_h": nh, "pad_x": pad(tw, nw), "pad_y": pad(th, nh)}


def letterbox_box(box, w: Column, h: Column, fit: dict[str, Column], tw: int = 640, th: int = 640) -> tuple[Column, Column, Column, Column]:
    """A box in fractions of a w x h image as fractions of the letterboxed one."""
    cx, cy, bw, bh = box
    scale = fit["scale"]
    return (cx * w * scale + fit["pad_x"]) / tw, (cy * h * scale + fit["pad_y"]) / th, bw * w * scale / tw, bh * h * scale / th


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def source_coordinate(d: Column, n_in: int, n_out: int) -> tuple[Column, Column, Column]:
    """(lower source cell, upper source cell, weight of the upper) for half-pixel-center bilinear scaling."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(float(n_in - 1)), (d + 0.5) * F.lit(n_in / n_out) - 0.5))
    low = F.floor(s).cast("int")
    return low, F.least(low + 1, F.lit(n_in - 1)), s - low
