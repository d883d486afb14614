"""The packed render path: whole images as numpy arrays, one fused Arrow stage a page.

An image is an array (height, width, 3) of uint8.  Every stage that stores pixels
clamps to 0..255 and rounds half to even.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import PAPER, homography, project
from .settings import DEFAULTS

LUMA = np.array([0.2126, 0.7152, 0.0722])
KNEE = 232.0


def store(v: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(v, 0, 255)).astype(np.uint8)


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def shoulder(v: np.ndarray) -> np.ndarray:
    return np.where(v <= KNEE, np.maximum(v, 0), KNEE + (255 - KNEE) * np.tanh((v - KNEE) / (255 - KNEE)))


# ---------------------------------------------------------------- resampling
@functools.lru_cache(maxsize=16)
def _axis_weights(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n cells falls into each of m, or linear interpolation when growing."""
    out = np.zeros((m, n))
    if m <= n:
        edges = np.linspace(0, n, m + 1)
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            cells = np.arange(int(a), min(n, math.ceil(b)))
            out[k, cells] = np.minimum(cells + 1, b) - np.maximum(cells, a)
        return out / out.sum(1, keepdims=True)
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out[np.arange(m), low] = 1 - (at - low)
    out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
    return out


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area averages when shrinking, bilinear when growing."""
    if img.shape[1] == w and img.shape[0] == h:
        return img
    rows = (_axis_weights(img.shape[0], h) @ img.reshape(img.shape[0], -1).astype(float)).reshape(h, img.shape[1], -1)
    return store(_axis_weights(img.shape[1], w) @ rows)


def fit(img: np.ndarray, longest: int) -> np.ndarray:
    h, w = img.shape[:2]
    k = min(1.0, longest / max(w, h))
    return resize(img, max(1, half_up(w * k)), max(1, half_up(h * k)))


def _bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    x0, y0 = np.clip(np.floor(x), 0, w - 1).astype(int), np.clip(np.floor(y), 0, h - 1).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    img = img.astype(float)
    return img[y0, x0] * (1 - fx) * (1 - fy) + img[y0, x1] * fx * (1 - fy) + img[y1, x0] * (1 - fx) * fy + img[y1, x1] * fx * fy


def warp(img: np.ndarray, corners: np.ndarray, w: int, h: int) -> np.ndarray:
    """The quad `corners` (normalised, clockwise from top left) straightened to w x h.
    Places beyond the image by more than a pixel, and a quad without a solution, are white."""
    sh, sw = img.shape[:2]
    m = homography(np.array([[0, 0], [w, 0], [w, h], [0, h]], dtype=float), np.asarray(corners, dtype=float) * [sw, sh])
    if m is None:
        return np.full((h, w, 3), 255, dtype=np.uint8)
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    at = project(m, np.column_stack([x.ravel(), y.ravel()])).reshape(h, w, 2) - 0.5
    out = store(_bilinear(img, at[..., 0], at[..., 1]))
    out[(at[..., 0] < -1) | (at[..., 1] < -1) | (at[..., 0] > sw) | (at[..., 1] > sh)] = 255
    return out


def transform(img: np.ndarray, rotate: float = 0, straighten: float = 0, flip_h: bool = False, flip_v: bool = False) -> np.ndarray:
    """Flips, then turns clockwise on white; quarter turns are exact."""
    if flip_h:
        img = img[:, ::-1]
    if flip_v:
        img = img[::-1]
    angle = rotate + straighten
    if angle % 90 == 0:
        return np.ascontiguousarray(np.rot90(img, -int(angle // 90) % 4))
    h, w = img.shape[:2]
    t = math.radians(angle)
    nw, nh = (max(1, half_up(abs(a * math.cos(t)) + abs(b * math.sin(t)))) for a, b in ((w, h), (h, w)))
    x, y = np.meshgrid(np.arange(nw) + 0.5 - nw / 2, np.arange(nh) + 0.5 - nh / 2)
    sx, sy = x * math.cos(t) + y * math.sin(t) + w / 2 - 0.5, -x * math.sin(t) + y * math.cos(t) + h / 2 - 0.5
    out = store(_bilinear(img, sx, sy))
    out[(sx < -0.5) | (sy < -0.5) | (sx > w - 0.5) | (sy > h - 0.5)] = 255
    return out


def target_size(settings: dict, corners: np.ndarray | None, w: int, h: int, longest: float) -> tuple[int, int]:
    bw, bh = w, h
    if corners is not None and not is_full_frame(corners):
        p = np.asarray(corners, dtype=float) * [w, h]
        side = lambda i, j: float(np.hypot(*(p[i] - p[j])))
        bw, bh = max(16, half_up(max(side(0, 1), side(3, 2)))), max(16, half_up(max(side(0, 3), side(1, 2))))
    if settings.get("outSize") in PAPER:
        short, long = PAPER[settings["outSize"]]
        bw, bh = (short, long) if bh >= bw else (long, short)
    k = longest / max(bw, bh)
    return (max(16, half_up(bw * k)), max(16, half_up(bh * k))) if k < 1 else (bw, bh)


def is_full_frame(corners: np.ndarray | None) -> bool:
    return corners is None or bool(np.all(np.abs(np.asarray(corners, dtype=float) - [[0, 0], [1, 0], [1, 1], [0, 1]]) <= 1e-4))


# ---------------------------------------------------------------- illumination
def _reflected_mean(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Means of 2r+1 neighbours along an axis; past an edge its point reflection."""
    a = np.moveaxis(a.astype(np.float64), axis, 0)
    n = len(a)
    i = np.arange(-r, n + r)
    mirrored = np.where(i < 0, np.minimum(-i, n - 1), np.where(i > n - 1, np.maximum(2 * (n - 1) - i, 0), i))
    edge = np.where(i < 0, 0, n - 1)
    out = (i < 0) | (i > n - 1)
    taps = np.where(out.reshape(-1, *[1] * (a.ndim - 1)), 2 * a[edge] - a[mirrored], a[mirrored])
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(taps, axis=0)])
    return np.moveaxis((total[2 * r + 1 :] - total[: -2 * r - 1]) / (2 * r + 1), 0, axis).astype(np.float32)


def soft(a: np.ndarray, r: int) -> np.ndarray:
    return _reflected_mean(_reflected_mean(a, r, 1), r, 0)


def illumination(img: np.ndarray) -> np.ndarray:
    """The light on the page, on a coarse grid: block maxima, softened broadly and a little."""
    h, w = img.shape[:2]
    bw, bh = (min(88, max(10, half_up(n / 14))) for n in (w, h))
    lum = (img @ LUMA).astype(np.float32)
    by, bx = np.minimum(bh - 1, np.arange(h) * bh // h), np.minimum(bw - 1, np.arange(w) * bw // w)
    blocks = np.zeros((bh, bw), dtype=np.float32)
    np.maximum.at(blocks, (by[:, None], bx[None, :]), lum)
    level = np.maximum(soft(blocks, max(2, half_up(min(bw, bh) / 3))), soft(blocks, 1) * np.float32(0.8))
    return np.maximum(level, max(16.0, max(1.0, float(level.max())) * 0.35)).astype(np.float32)


def flatten(img: np.ndarray, strength: float) -> np.ndarray:
    """Divides the image by its light; strength is an exponent of the gain."""
    gain = np.clip((255 / illumination(img).astype(float)) ** (min(max(strength, 0), 100) / 100), 0.2, 3.5).astype(np.float32)
    h, w = img.shape[:2]
    x, y = np.meshgrid((np.arange(w) + 0.5) / w * gain.shape[1] - 0.5, (np.arange(h) + 0.5) / h * gain.shape[0] - 0.5)
    return store(shoulder(img * _bilinear(gain, x, y)[..., None]))


# ---------------------------------------------------------------- colour and tone
def level_at(values: np.ndarray, share: float) -> int:
    """The first of 256 levels at which the running count reaches a share of all."""
    count = np.cumsum(np.bincount(values, minlength=256))
    return int(np.searchsorted(count, count[-1] * share, "left"))


def white_balance(img: np.ndarray, mode: str) -> np.ndarray:
    if mode not in ("gray", "white"):
        return img
    some = img.reshape(-1, 3)[:: max(1, img.shape[0] * img.shape[1] // 40000)]
    if mode == "gray":
        lum = some @ LUMA
        light = some[lum >= max(24.0, 0.55 * level_at(np.minimum(255, lum.astype(int)), 0.9))].astype(float)
        if len(light) < 32:
            return img
        m = light.mean(0)
        gain = m.sum() / 3 / np.where(m == 0, 1, m)
    else:
        gain = 248 / np.array([max(1, level_at(some[:, c], 0.97)) for c in range(3)])
    return store(img * np.clip(gain, 0.55, 1.9))


def tone_table(a: dict) -> np.ndarray:
    c = min(max(a["contrast"], -100), 100) * 2.55
    v = 259 * (c + 255) / (255 * (259 - c)) * (np.arange(256) + a["exposure"] * 1.28 - 128) + 128
    v = 255 * (np.clip(v, 0, 255) / 255) ** (1 / min(max(a["gamma"], 0.05), 10))
    n = v / 255
    v = v + a["shadows"] * 1.15 * (1 - n) ** 2.2 + a["highlights"] * 1.15 * n**2.2
    return np.clip(np.floor(np.where(v > KNEE, shoulder(v), v) + 0.5), 0, 255).astype(np.uint8)


def saturate(img: np.ndarray, saturation: float, vibrance: float) -> np.ndarray:
    v = img.astype(float)
    lum = (v @ LUMA)[..., None]
    amount = 1 + saturation / 100 + vibrance / 100 * (1 - (v.max(-1) - v.min(-1)) / 255)
    return store(lum + (v - lum) * amount[..., None])


# ---------------------------------------------------------------- detail
def median3(img: np.ndarray, strength: float) -> np.ndarray:
    p = np.pad(img, ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = img.shape[:2]
    m = np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)
    return store(img + (m - img) * (strength / 100))


def _edge_mean(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r + 1, r)
    total = np.cumsum(np.pad(a.astype(np.float64), pad, mode="edge"), axis=axis)
    n = a.shape[axis]
    return ((np.take(total, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(total, range(n), axis)) / (2 * r + 1)).astype(np.float32)


def sharpen(img: np.ndarray, amount: float) -> np.ndarray:
    r = min(6, max(1, half_up(max(img.shape[:2]) / 1500)))
    blur = _edge_mean(_edge_mean(img, r, 1), r, 0)
    return store(shoulder(img + (img - blur.astype(float)) * (amount / 100)))


def bilevel(img: np.ndarray, bias: float, window: float) -> np.ndarray:
    """Black where a pixel is darker than the mean of its window by a margin."""
    gray = img @ LUMA
    h, w = gray.shape
    r = half_up(min(w, h) / 16 * (window / 100) / 2)
    r = max(0, min(max(r, 3), min(w, h) // 2 - 1))
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.cumsum(0).cumsum(1)
    y0, y1 = np.maximum(0, np.arange(h) - r), np.minimum(h, np.arange(h) + r + 1)
    x0, x1 = np.maximum(0, np.arange(w) - r), np.minimum(w, np.arange(w) + r + 1)
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    count = np.outer(y1 - y0, x1 - x0)
    v = np.where(gray * count < sums * (1 - min(0.6, max(0.005, 0.13 - bias / 500))), 0, 255).astype(np.uint8)
    return np.repeat(v[..., None], 3, axis=2)


def color(img: np.ndarray, a: dict) -> np.ndarray:
    """All colour stages in their order; a stage that would change nothing is left out."""
    a = DEFAULTS | {"invert": False} | {k: v for k, v in a.items() if v is not None}
    if a["flatten"] > 0:
        img = flatten(img, a["flatten"])
    img = white_balance(img, a["wb"])
    if a["temp"] or a["tint"]:
        t, ti = a["temp"] / 300, a["tint"] / 300
        img = store(img * np.array([(1 + t) * (1 - ti / 2), 1 + ti, (1 - t) * (1 - ti / 2)]))
    if a["contrast"] or a["exposure"] or a["highlights"] or a["shadows"] or abs(a["gamma"] - 1) >= 1e-6:
        img = tone_table(a)[img]
    if a["mode"] == "color" and (a["saturation"] or a["vibrance"]):
        img = saturate(img, a["saturation"], a["vibrance"])
    if a["denoise"] > 0:
        img = median3(img, a["denoise"])
    if a["sharpen"] > 0:
        img = sharpen(img, a["sharpen"])
    if a["mode"] == "gray":
        img = np.repeat(store(img @ LUMA)[..., None], 3, axis=2)
    elif a["mode"] == "bw":
        img = bilevel(img, a["threshold"], a["window"])
    return 255 - img if a["invert"] else img


def render(img: np.ndarray, a: dict, corners: np.ndarray | None = None, longest: float = math.inf) -> np.ndarray:
    """Crop or resize, turn, then colour."""
    h, w = img.shape[:2]
    tw, th = target_size(a, corners, w, h, longest)
    img = resize(img, tw, th) if is_full_frame(corners) else warp(img, corners, tw, th)
    return color(transform(img, a.get("rotate") or 0, a.get("straighten") or 0, bool(a.get("flipH")), bool(a.get("flipV"))), a)


IMAGE = "id string, w int, h int, data binary"


def unpack(w: int, h: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(h, w, 3)


def render_pages(pages: DataFrame, longest: float = math.inf) -> DataFrame:
    """pages (id, w, h, data, corners array<double> or null, settings map<string,string> or null)
    rendered, one page after another inside each task: no shuffle, one page in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = {}
                for k, v in dict(r.settings or {}).items():
                    kind = DEFAULTS.get(k, 0.0 if k in ("rotate", "straighten") else "")
                    a[k] = v == "true" if k in ("invert", "flipH", "flipV") else (float(v) if isinstance(kind, float) else v)
                quad = None if r.corners is None else np.asarray(r.corners, dtype=float).reshape(4, 2)
                out = render(unpack(r.w, r.h, r.data), a, quad, longest)
                yield pd.DataFrame([(r.id, out.shape[1], out.shape[0], out.tobytes())], columns=["id", "w", "h", "data"])

    return pages.select("id", "w", "h", "data", "corners", "settings").mapInPandas(run, IMAGE)


def fit_images(images: DataFrame, longest: int) -> DataFrame:
    """Packed images no longer than `longest`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = fit(unpack(r.w, r.h, r.data), longest)
                yield pd.DataFrame([(r.id, out.shape[1], out.shape[0], out.tobytes())], columns=["id", "w", "h", "data"])

    return images.select("id", "w", "h", "data").mapInPandas(run, IMAGE)


def identity_tone(contrast: Column, exposure: Column, gamma: Column, highlights: Column, shadows: Column) -> Column:
    """Whether the tone table would change nothing."""
    return (contrast == 0) & (exposure == 0) & (highlights == 0) & (shadows == 0) & (F.abs(gamma - 1) < 1e-6)
