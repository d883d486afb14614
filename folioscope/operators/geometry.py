"""Quadrilaterals and sizes as column expressions; solved geometry with numpy.

A quad is eight columns x0, y0 ... x3, y3: top left, top right, bottom right, bottom left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUAD = [f"{a}{i}" for i in range(4) for a in "xy"]
#: Pixels of paper at 300 dpi, and the long edge of A4 in inches.
PAPER = {"a4": (2480, 3508), "letter": (2550, 3300)}
A4_INCHES = 11.69


def _round(v: Column) -> Column:
    return F.floor(v + 0.5)


def _edge(i: int, j: int, w: Column, h: Column) -> Column:
    dx, dy = (F.col(f"x{i}") - F.col(f"x{j}")) * w, (F.col(f"y{i}") - F.col(f"y{j}")) * h
    return F.sqrt(dx * dx + dy * dy)


def output_size(w: Column, h: Column) -> tuple[Column, Column]:
    """Pixels a normalised quad unwarps to: the longer of opposite edges, 16 at least."""
    wide = F.greatest(_edge(0, 1, w, h), _edge(3, 2, w, h))
    tall = F.greatest(_edge(0, 3, w, h), _edge(1, 2, w, h))
    return F.greatest(F.lit(16), _round(wide)).cast("int"), F.greatest(F.lit(16), _round(tall)).cast("int")


def is_full_frame() -> Column:
    full = dict(zip(QUAD, (0, 0, 1, 0, 1, 1, 0, 1)))
    out = F.lit(True)
    for c, v in full.items():
        out = out & (F.coalesce(F.abs(F.col(c) - F.lit(float(v))), F.lit(0.0)) <= 1e-4)
    return out


def target_size(w: Column, h: Column, paper: Column, longest: float | None) -> tuple[Column, Column]:
    """The size a page renders to: quad or frame, turned paper size, capped long edge."""
    qw, qh = output_size(w, h)
    bw, bh = F.when(is_full_frame(), w).otherwise(qw), F.when(is_full_frame(), h).otherwise(qh)
    upright = bh >= bw
    pw, ph = bw, bh
    for name, (short, long) in PAPER.items():
        pw = F.when(paper == name, F.when(upright, short).otherwise(long)).otherwise(pw)
        ph = F.when(paper == name, F.when(upright, long).otherwise(short)).otherwise(ph)
    if longest is None:
        return pw.cast("int"), ph.cast("int")
    k = F.lit(float(longest)) / F.greatest(pw, ph)
    return tuple(F.when(k < 1, F.greatest(F.lit(16), _round(v * k))).otherwise(v).cast("int") for v in (pw, ph))


def area() -> Column:
    out = F.lit(0.0)
    for i in range(4):
        j = (i + 1) % 4
        out = out + (F.col(f"x{i}") * F.col(f"y{j}") - F.col(f"x{j}") * F.col(f"y{i}"))
    return F.abs(out) / 2


def is_valid(w: Column, h: Column, share: float = 0.045, least: float = 45.0, most: float = 135.0) -> Column:
    """Whether a quad in pixels covers enough of the frame and has plausible angles."""
    out = area() >= w * h * F.lit(share)
    for i in range(4):
        a, c = (i + 3) % 4, (i + 1) % 4
        ux, uy, vx, vy = (F.col(f"{k}{p}") - F.col(f"{k}{i}") for p in (a, c) for k in "xy")
        size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
        cos = (ux * vx + uy * vy) / F.when(size == 0, F.lit(1.0)).otherwise(size)
        angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))) * F.lit(180.0) / F.lit(float(np.pi))
        out = out & angle.between(least, most)
    return out


def inside(x: Column, y: Column) -> Column:
    """Whether a place lies on one side of all edges; places on an edge count as inside."""
    signs = []
    for i in range(4):
        j = (i + 1) % 4
        signs.append(F.signum((F.col(f"x{j}") - F.col(f"x{i}")) * (y - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (x - F.col(f"x{i}"))))
    return ~((F.greatest(*signs) > 0) & (F.least(*signs) < 0))


def ordered() -> list[Column]:
    """The corners sorted by angle about their middle, from the one most to the top left."""
    cx, cy = (F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3")) / 4, (F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3")) / 4
    pts = F.array(*[F.struct(F.atan2(F.col(f"y{i}") - cy, F.col(f"x{i}") - cx).alias("a"), F.lit(i).alias("i"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(4)])
    by_angle = F.array_sort(pts)
    first = F.array_min(F.transform(by_angle, lambda p, k: F.struct((p["x"] + p["y"]).alias("d"), k.alias("k"))))["k"]
    turned = F.concat(F.slice(by_angle, first + 1, F.lit(4)), F.slice(by_angle, F.lit(1), first))
    return [turned[i][a].alias(f"{a}{i}") for i in range(4) for a in "xy"]


def unit_square_map() -> Column:
    """The nine coefficients, by row, of the map that takes the unit square's corners onto the
    quad's, in closed form; null if three corners lie on a line so that there is none."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4))
    ux, uy, vx, vy = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = ux * vy - vx * uy
    g, h = (sx * vy - vx * sy) / det, (ux * sy - sx * uy) / det
    m = F.array(x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0))
    flat = (x1 - x0) * (y3 - y0) - (x3 - x0) * (y1 - y0)
    return F.when((F.abs(det) >= 1e-12) & (F.abs(flat) >= 1e-12), m)


def nearest_corner(px: Column, py: Column, w: Column, h: Column, reach: float = 26.0) -> Column:
    """The corner nearest a place, null if none is within `reach` pixels; the first of equals."""
    d = [F.struct((F.sqrt(F.pow((F.col(f"x{i}") - px) * w, F.lit(2.0)) + F.pow((F.col(f"y{i}") - py) * h, F.lit(2.0))) / w).alias("d"), F.lit(i).alias("i")) for i in range(4)]
    best = F.array_min(F.array(*d))
    return F.when(best["d"] < F.lit(reach) / F.greatest(w, F.lit(1)), best["i"])


def dots_per_inch(out_w: Column, out_h: Column) -> Column:
    return _round(F.greatest(out_w, out_h) / F.lit(A4_INCHES)).cast("int")


def coverage(out_w: Column, out_h: Column, w: Column, h: Column) -> Column:
    """Percent of the frame's edge that a crop uses."""
    return _round(F.sqrt(out_w * out_h / (w * h)) * 100).cast("int")


def turned(pixels: DataFrame, w: int, h: int, quarter: int) -> DataFrame:
    """Tall pixels turned clockwise by quarters, exactly."""
    x, y = F.col("x"), F.col("y")
    nx, ny = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[quarter % 4]
    return pixels.withColumns({"x": nx, "y": ny})


def flipped(pixels: DataFrame, w: int, h: int, across: bool, down: bool) -> DataFrame:
    return pixels.withColumns({"x": F.lit(w - 1) - F.col("x") if across else F.col("x"), "y": F.lit(h - 1) - F.col("y") if down else F.col("y")})


# ---------------------------------------------------------------- numpy
def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The 3x3 matrix that takes four points onto four others; None if they give none."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        right += [u, v]
    a = np.array(rows, dtype=float)
    scale = np.abs(a).max()
    if not scale or np.linalg.svd(a, compute_uv=False)[-1] < 1e-12 * scale:
        return None
    return np.append(np.linalg.solve(a, np.array(right, dtype=float)), 1.0).reshape(3, 3)


def project(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ m.T
    return p[:, :2] / p[:, 2:]


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of integer points, in order, without points on its edges."""
    pts = np.unique(np.asarray(points), axis=0)
    if len(pts) < 3:
        return pts

    def half(side):
        out: list = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                del out[-1]
            out.append(p)
        return out[:-1]

    rows = pts.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def to_quad(poly: np.ndarray) -> np.ndarray:
    """A convex polygon cut down to four corners, each time without the one that costs least area."""
    poly = np.asarray(poly, dtype=float)
    while len(poly) > 4:
        a, c = np.roll(poly, 1, axis=0), np.roll(poly, -1, axis=0)
        loss = np.abs((poly[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (poly[:, 1] - a[:, 1]))
        poly = np.delete(poly, int(loss.argmin()), axis=0)
    return poly
