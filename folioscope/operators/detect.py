"""Page detection on packed rasters: threshold, closing, largest component, quad, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .geometry import hull, to_quad
from .pages import redetected
from .raster import half_up, resize, unpack

WORK = 320


def otsu(gray: np.ndarray) -> int:
    """The level that best splits the values; the lowest of equals, 128 if there is one level only."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    good = (below > 0) & (above > 0)
    if not good.any():
        return 128
    gap = mass / np.where(below > 0, below, 1) - (mass[-1] - mass) / np.where(above > 0, above, 1)
    return int(np.argmax(np.where(good, below * above * gap * gap, -1)))


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 0):
        n = mask.shape[axis]
        total = np.cumsum(np.insert(mask.astype(np.int32), 0, 0, axis=axis), axis=axis)
        i = np.arange(n)
        mask = np.take(total, np.minimum(n, i + r + 1), axis) > np.take(total, np.maximum(0, i - r), axis)
    return mask


def largest_component(mask: np.ndarray) -> np.ndarray | None:
    """The largest 4-connected part; the one met first in reading order of equals.
    Runs of each row are joined where they touch those of the row above."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1]
    if not len(row):
        return None
    parent = list(range(len(row)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] < b[j] and a[j] < b[i]:
                x, z = root(i), root(j)
                parent[max(x, z)] = min(x, z)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    label = np.array([root(k) for k in range(len(row))])
    best = int(np.argmax(np.bincount(label, b - a)))
    out = np.zeros((h, w), dtype=bool)
    for k in np.flatnonzero(label == best):
        out[row[k], a[k] : b[k]] = True
    return out


def _order(quad: np.ndarray) -> np.ndarray:
    d = quad - quad.mean(0)
    quad, d = (x[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")] for x in (quad, d))
    return np.roll(quad, -int(np.argmin(d.sum(1))), axis=0)


def _area(q: np.ndarray) -> float:
    n = np.roll(q, -1, axis=0)
    return abs(float((q[:, 0] * n[:, 1] - n[:, 0] * q[:, 1]).sum())) / 2


def is_valid(q: np.ndarray, w: int, h: int) -> bool:
    if _area(q) < 0.045 * w * h:
        return False
    u, v = np.roll(q, 1, axis=0) - q, np.roll(q, -1, axis=0) - q
    size = np.hypot(*u.T) * np.hypot(*v.T)
    angle = np.degrees(np.arccos(np.clip((u * v).sum(1) / np.where(size == 0, 1, size), -1, 1)))
    return bool((np.abs(angle - 90) <= 45 + 1e-9).all())  # an angle of 45 degrees may come out a little less


def _attempt(gray: np.ndarray, thr: int, bright: bool) -> np.ndarray | None:
    h, w = gray.shape
    mask = gray > thr if bright else gray < thr
    part = largest_component(dilate(mask, max(2, half_up(min(w, h) * 0.025))))
    if part is None:
        return None
    page = mask & part
    n = int(page.sum())
    if not 0.05 * w * h <= n <= 0.985 * w * h:
        return None
    ys, xs = np.flatnonzero(page.any(1)), np.flatnonzero(page.any(0))
    points = np.concatenate([
        np.column_stack([page[ys].argmax(1), ys]), np.column_stack([w - 1 - page[ys, ::-1].argmax(1), ys]),
        np.column_stack([xs, page[:, xs].argmax(0)]), np.column_stack([xs, h - 1 - page[::-1, xs].argmax(0)]),
    ])
    if len(points) < 8 or n == w * h or abs(gray[page].mean() - gray[~page].mean()) < 12:
        return None
    quad = to_quad(hull(points))
    if len(quad) != 4:
        return None
    quad = _order(quad)
    size = _area(quad)
    if not is_valid(quad, w, h) or n < size / 2 or size > 0.95 * w * h:
        return None
    d = quad - quad.mean(0)
    far = np.hypot(*d.T)[:, None]
    return np.clip((quad - 0.8 * d / np.where(far == 0, 1, far)) / [w, h], 0, 1)


def prepared(img: np.ndarray, work: int = WORK, least: int = 40) -> np.ndarray:
    """Gray values at working size: the long edge `work`, each edge `least` at least."""
    h, w = img.shape[:2]
    k = work / max(w, h)
    small = resize(img, max(least, half_up(w * k)), max(least, half_up(h * k))).astype(np.int32)
    return (small @ np.array([77, 150, 29])) >> 8


def choose(guess: bool, held: bool | None, attempt) -> tuple[object, bool | None]:
    """Tries the polarity that held last, or else the guess, then the other: what attempt(bright)
    gives, and the polarity it came of; (None, None) if neither gives anything."""
    first = guess if held is None else held
    for bright in (first, not first):
        found = attempt(bright)
        if found is not None:
            return found, bright
    return None, None


def detect(img: np.ndarray, first: bool | None = None, work: int = WORK, least: int = 40) -> tuple[np.ndarray | None, bool | None]:
    """The page's quad, normalised, and whether it is brighter than its surroundings; or
    (None, None).  `first`: the polarity to try before the other, e.g. the last one that held."""
    gray = prepared(img, work, least)
    h, w = gray.shape
    thr, m = otsu(gray), max(2, half_up(min(w, h) * 0.04))
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    border = (x < m) | (y < m) | (x >= w - m) | (y >= h - m)
    centre = ~border & (x > w * 0.35) & (x < w * 0.65) & (y > h * 0.35) & (y < h * 0.65)
    mean = lambda some: gray[some].mean() if some.any() else 0.0
    return choose(bool(mean(centre) >= mean(border)), first, lambda bright: _attempt(gray, thr, bright))


def detect_pages(pages: DataFrame, work: int = WORK, least: int = 40) -> DataFrame:
    """(id, corners array<double> or null, bright) of images (id, w, h, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                quad, bright = detect(unpack(r.w, r.h, r.data), None, work, least)
                rows.append((r.id, None if quad is None else quad.ravel().tolist(), bright))
            yield pd.DataFrame(rows, columns=["id", "corners", "bright"])

    return pages.select("id", "w", "h", "data").mapInPandas(run, "id string, corners array<double>, bright boolean")


def redetect(pages: DataFrame) -> DataFrame:
    """pages (id, w, h, data, corners, ...) with outlines found anew; null, the whole frame, where none is."""
    return redetected(pages, detect_pages(pages).select("id", "corners"))


# ---------------------------------------------------------------- one camera after another frame
FOUND = "camera string, seq long, corners array<double>, bright boolean"


def _follow(pdf: pd.DataFrame, held: bool | None, work: int, least: int) -> tuple[pd.DataFrame, bool | None]:
    """Frames of one camera in order; the polarity that held is tried first on the next."""
    rows = []
    for r in pdf.sort_values("seq").itertuples(index=False):
        quad, bright = detect(unpack(r.w, r.h, r.data), held, work, least)
        held = held if bright is None else bright
        rows.append((r.camera, r.seq, None if quad is None else quad.ravel().tolist(), bright))
    return pd.DataFrame(rows, columns=["camera", "seq", "corners", "bright"]), held


def detect_frames(frames: DataFrame, work: int = WORK, least: int = 40) -> DataFrame:
    """Outlines in frames (camera, seq, w, h, data), each camera's in order in one task; give a
    camera's stretches (a day, say) names of their own where one is too long for that."""
    return frames.select("camera", "seq", "w", "h", "data").groupBy("camera").applyInPandas(lambda pdf: _follow(pdf, None, work, least)[0], FOUND)


def detect_frames_stream(frames: DataFrame, work: int = WORK, least: int = 40) -> DataFrame:
    """The same over a stream: a camera's polarity lives in the state store."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {1: True, 0: False}.get(state.get[0]) if state.exists else None
        out, held = _follow(pd.concat(list(parts)), held, work, least)
        state.update((-1 if held is None else int(held),))
        yield out

    return frames.select("camera", "seq", "w", "h", "data").groupBy("camera").applyInPandasWithState(run, FOUND, "bright int", "append", GroupStateTimeout.NoTimeout)


def polarity_track(outcomes: DataFrame) -> DataFrame:
    """(camera, seq, bright) of what frames would give (camera, seq, guess, bright_ok, dark_ok):
    the rule of detect_frames() alone, without pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        for guess, ok, dark in zip(pdf["guess"], pdf["bright_ok"], pdf["dark_ok"]):
            _, bright = choose(bool(guess), held, lambda b: True if (ok if b else dark) else None)  # noqa: B023
            held = held if bright is None else bright
            out.append(bright)
        return pd.DataFrame({"camera": pdf["camera"], "seq": pdf["seq"], "bright": pd.array(out, dtype="boolean")})

    return outcomes.groupBy("camera").applyInPandas(run, f"camera {dict(outcomes.dtypes)['camera']}, seq long, bright boolean")
