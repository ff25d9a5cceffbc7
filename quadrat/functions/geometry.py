"""Box geometry as column expressions: structs of x1, y1, x2, y2 with half-open edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")
#: Upper edges (exclusive) and names of the size bins, by the side of a square of equal area.
SIZE_BINS = ((16, "<16"), (32, "16-32"), (96, "32-96"))
LARGEST_BIN = ">=96"


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(map(_col, (x1, y1, x2, y2)), EDGES)))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def parts(b: Column | str) -> tuple[Column, Column, Column, Column]:
    b = _col(b)
    return tuple(b[e] for e in EDGES)


def area(b) -> Column:
    """Area, 0 for a box turned inside out."""
    x1, y1, x2, y2 = parts(b)
    zero = F.lit(0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def intersection(a, b) -> Column:
    ax1, ay1, ax2, ay2 = parts(a)
    bx1, by1, bx2, by2 = parts(b)
    zero = F.lit(0)
    return F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))


def _signed_area(b) -> Column:
    x1, y1, x2, y2 = parts(b)
    return (x2 - x1) * (y2 - y1)


def union_area(a, b) -> Column:
    return _signed_area(a) + _signed_area(b) - intersection(a, b)


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is 0."""
    u = union_area(a, b)
    return F.when(u == 0, F.lit(0.0)).otherwise(intersection(a, b) / u)


def ios(a, b) -> Column:
    """Intersection over the smaller box; 0 where that is empty."""
    smaller = F.least(_signed_area(a), _signed_area(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(intersection(a, b) / smaller)


def iou_at_least(a, b, num: int, den: int) -> Column:
    """iou >= num / den without a division: exact for integer boxes.

    den * i >= num * (areas - i), with each side once: as a join's condition it is code that stays small.
    """
    ax1, ay1, ax2, ay2 = parts(a)
    bx1, by1, bx2, by2 = parts(b)
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return (w > 0) & (h > 0) & (F.lit(num + den) * (w * h) >= F.lit(num) * (_signed_area(a) + _signed_area(b)))


def overlaps(a, b) -> Column:
    ax1, ay1, ax2, ay2 = parts(a)
    bx1, by1, bx2, by2 = parts(b)
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def size_bin(b) -> Column:
    """Size bin of a box by the square root of its area, compared as areas."""
    out = None
    for edge, name in SIZE_BINS:
        test = area(b) < edge * edge
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(LARGEST_BIN)


def touches_edge(b, width, height, tolerance: float = 1.0) -> Column:
    """Whether the box comes within tolerance of a border of its view."""
    x1, y1, x2, y2 = parts(b)
    return (x1 <= tolerance) | (y1 <= tolerance) | (x2 >= _col(width) - tolerance) | (y2 >= _col(height) - tolerance)


def box_fault(b, width, height) -> Column:
    """null for a valid box, else the code 'invalid_box': finite edges, 0 <= low < high <= size."""
    x1, y1, x2, y2 = parts(b)
    fine = (x1 >= 0) & (x1 < x2) & (x2 <= _col(width)) & (y1 >= 0) & (y1 < y2) & (y2 <= _col(height))
    for edge in (x1, y1, x2, y2):
        as_double = edge.cast("double")
        fine = fine & ~F.isnan(as_double) & (F.abs(as_double) < float("inf"))
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(None).cast("string")).otherwise("invalid_box")


def checked(b, width, height) -> Column:
    """The box, or an error that names the fault."""
    return F.when(box_fault(b, width, height).isNull(), _col(b)).otherwise(F.raise_error(F.lit("invalid_box")))


def transform(b, matrix: Sequence[Sequence[float]]) -> Column:
    """The axis-aligned hull of the box's four corners under a 3x3 homography; null where a corner is at infinity."""
    x1, y1, x2, y2 = parts(b)
    m = [[float(v) for v in row] for row in matrix]
    det = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
    if len(m) != 3 or any(len(r) != 3 for r in m) or not abs(det) >= 1e-12:
        raise ValueError("invalid_transform")
    xs, ys = [], []
    for x, y in ((x1, y1), (x2, y1), (x1, y2), (x2, y2)):
        u, v, w = (F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) for r in m)
        far = F.when(F.abs(w) >= 1e-12, w)
        xs.append(u / far)
        ys.append(v / far)
    hull = box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    whole = xs[0].isNotNull() & xs[1].isNotNull() & xs[2].isNotNull() & xs[3].isNotNull()
    return F.when(whole, hull)


def clip(b, width, height) -> Column:
    x1, y1, x2, y2 = parts(b)
    zero = F.lit(0)
    return box(F.greatest(zero, x1), F.greatest(zero, y1), F.least(_col(width), x2), F.least(_col(height), y2))


def from_xywh(x, y, w, h) -> Column:
    x, y, w, h = map(_col, (x, y, w, h))
    return box(x, y, x + w, y + h)


def shift(b, dx, dy) -> Column:
    x1, y1, x2, y2 = parts(b)
    return box(x1 + _col(dx), y1 + _col(dy), x2 + _col(dx), y2 + _col(dy))


def crop(b, width, height, context: float) -> Column:
    """The box padded by a share of its size, clipped to the image and cut to whole pixels."""
    x1, y1, x2, y2 = parts(b)
    px, py = (x2 - x1) * context, (y2 - y1) * context
    wide = clip(box(x1 - px, y1 - py, x2 + px, y2 + py), width, height)
    return box(*(e.cast("int") for e in parts(wide)))


def to_yolo(b, width, height, index) -> Column:
    """'class cx cy w h' with normalised centre and size, six decimals."""
    x1, y1, x2, y2 = parts(b)
    w, h = _col(width), _col(height)
    return F.format_string("%d %.6f %.6f %.6f %.6f", _col(index), (x1 + x2) / F.lit(2.0) / w, (y1 + y2) / F.lit(2.0) / h, (x2 - x1) / w, (y2 - y1) / h)


def round_half_up(value) -> Column:
    return F.floor(_col(value) + F.lit(0.5))


def fused(b, score) -> Column:
    """Score-weighted mean box of a group (an aggregate); a weight is at least a millionth."""
    weight = F.greatest(_col(score).cast("double"), F.lit(1e-6))
    return box(*(F.sum(e * weight) / F.sum(weight) for e in parts(b)))
