"""The packed pipeline: geometry, light, tone and detection on made-up scenes."""

import numpy as np
import pytest

from folioscope.operators import detect, geometry, neighbour, raster, settings

W, H = 640, 480


def uv_of(quad, w, h):
    """Page coordinates of every pixel."""
    m = geometry.homography(np.asarray(quad, dtype=float) * [w, h], np.array([[0, 0], [1, 0], [1, 1], [0, 1]], dtype=float))
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    return geometry.project(m, np.column_stack([x.ravel(), y.ravel()])).reshape(h, w, 2), x / w, y / h


def cloud(rng, size):
    """A smooth field of random values between -1 and 1."""
    coarse = rng.uniform(-1, 1, (5, 7, 1))
    return (raster._axis_weights(5, size[0]) @ coarse.reshape(5, 7) @ raster._axis_weights(7, size[1]).T)[..., None]


def random_quad(rng, share):
    """A sheet of about a share of the frame's edge, turned and seen a little from the side."""
    a, b, turn = share * rng.uniform(0.7, 0.8) * W / 2, share * rng.uniform(0.65, 0.75) * H / 2, rng.uniform(-0.2, 0.2)
    box = np.array([[-a, -b], [a, -b], [a, b], [-a, b]])
    spin = np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    return (box @ spin + rng.uniform(-0.03, 0.03, (4, 2)) * H + [W / 2, H / 2]) / [W, H]


def desk_scene(rng, quad=None, ground=45.0, sheet=232.0, lamp=0.0, noise=1.5):
    """A textured ground, and on it a sheet with random blots, under a lamp that falls off to one side."""
    img = ground * rng.uniform(0.97, 1.03, 3) + 6 * cloud(rng, (H, W))
    if quad is not None:
        uv, _, _ = uv_of(quad, W, H)
        there = ((uv >= 0) & (uv <= 1)).all(-1)
        paper = np.full((H, W), float(sheet))
        for _ in range(50):
            (u, v), (du, dv) = rng.uniform(0.18, 0.82, 2), rng.uniform(0.01, 0.07, 2)
            paper[(np.abs(uv[..., 0] - u) < du) & (np.abs(uv[..., 1] - v) < dv / 4)] = sheet + (ground - sheet) * 0.8
        img = np.where(there[..., None], paper[..., None] * [1, 0.99, 0.97], img)
    slope = np.linspace(1 - lamp, 1, W)[None, :, None] if rng.random() < 0.5 else np.linspace(1, 1 - lamp, H)[:, None, None]
    return raster.store(img * slope + rng.normal(0, noise, (H, W, 1)))


@pytest.mark.parametrize("options", [
    {"share": 0.9}, {"share": 0.8, "lamp": 0.35}, {"share": 1.0, "lamp": 0.5}, {"share": 0.5}, {"share": 0.95, "noise": 2.2},
    {"share": 0.85, "ground": 235.0, "sheet": 50.0}, {"share": 0.9, "ground": 110.0, "sheet": 240.0}, {"share": 1.05},
])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_detection_finds_the_sheet(options, seed):
    options = dict(options)
    rng = np.random.default_rng(seed)
    quad = random_quad(rng, options.pop("share"))
    found, bright = detect.detect(desk_scene(rng, quad, **options))
    assert found is not None and bright == (options.get("sheet", 232.0) > options.get("ground", 45.0))
    assert np.abs((found - quad) * [1, H / W]).max() < (0.035 if options.get("lamp", 0) > 0.4 else 0.025)


@pytest.mark.parametrize("options", [{}, {"ground": 160.0, "noise": 5.0}, {"lamp": 0.2}, {"share": 0.9, "ground": 214.0, "sheet": 219.0}, {"share": 0.25}])
def test_detection_declines(options):
    options = dict(options)
    rng = np.random.default_rng(5)
    quad = random_quad(rng, options.pop("share")) if "share" in options else None
    found, _ = detect.detect(desk_scene(rng, quad, **options))
    assert found is None


def test_detection_of_a_sheet_that_leaves_the_frame():
    rng = np.random.default_rng(11)
    quad = np.array([[0.28, 0.17], [1.30, 0.11], [1.26, 0.90], [0.33, 0.85]])
    at = lambda p, q: p + (q - p) * (1 - p[0]) / (q[0] - p[0])  # noqa: E731  where a side leaves
    want = np.array([quad[0], at(quad[0], quad[1]), at(quad[3], quad[2]), quad[3]])
    found, _ = detect.detect(desk_scene(rng, quad))
    assert np.abs((found - want) * [1, H / W]).max() < 0.035


def test_polarity_is_tried_first():
    rng = np.random.default_rng(3)
    assert detect.detect(desk_scene(rng, random_quad(rng, 0.9)), first=False)[1] is True
    tried = []
    assert detect.choose(True, False, lambda b: tried.append(b)) == (None, None) and tried == [False, True]


def test_homography():
    a, b = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]]), np.array([[5, 5], [25, 7], [23, 30], [3, 26.0]])
    assert np.abs(geometry.project(geometry.homography(a, b), a) - b).max() < 1e-9
    assert geometry.homography(np.zeros((4, 2)), b) is None


def test_warp_recovers_quadrants():
    h, w = 480, 640
    quad = np.array([[0.18, 0.12], [0.86, 0.20], [0.79, 0.90], [0.11, 0.78]])
    uv, _, _ = uv_of(quad, w, h)
    colours = np.array([[240, 240, 240], [200, 60, 60], [60, 200, 60], [60, 60, 200]], dtype=np.uint8)
    img = colours[(uv[..., 0] > 0.5).astype(int) + 2 * (uv[..., 1] > 0.5)]
    out = raster.warp(img, quad, 300, 400)
    for k, (y, x) in enumerate([(100, 75), (100, 225), (300, 75), (300, 225)]):
        assert np.abs(out[y, x].astype(int) - colours[k]).max() <= 12
    assert (raster.warp(img, np.zeros((4, 2)), 5, 5) == 255).all()


def lamp_page(w=400, h=300):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    v = np.where(y % 24 < 6, 35, 250) * (0.34 + 0.66 * x / w)
    return raster.store(np.repeat(v[..., None], 3, axis=2))


def test_flatten_removes_the_gradient():
    img = lamp_page()
    paper = lambda a, x: a[6:24, x].max()
    before = int(paper(img, 390)) - int(paper(img, 10))
    out = raster.flatten(img, 100)
    assert abs(int(paper(out, 390)) - int(paper(out, 10))) < 0.15 * before


def test_auto_makes_paper_white_and_keeps_ink_dark():
    out = raster.color(lamp_page(), settings.preset_record("auto") | {"sharpen": 0, "denoise": 0})
    paper = out[np.arange(300) % 24 >= 10]
    assert paper.mean() > 248 and abs(paper[:, :40].mean() - paper[:, -40:].mean()) < 6
    assert out[np.arange(300) % 24 == 3].mean() < 130


def test_bilevel_is_bilevel_and_right():
    w, h = 320, 240
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    ink = y % 20 < 5
    img = raster.store(np.repeat((np.where(ink, 45, 245) * (0.30 + 0.70 * x / w))[..., None], 3, axis=2))
    out = raster.color(img, settings.preset_record("bw"))
    assert set(np.unique(out)) <= {0, 255}
    assert ((out[..., 0] == 0) != ink).mean() < 0.02


def test_gray_has_no_chroma_and_invert_inverts():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    out = raster.color(img, settings.preset_record("gray"))
    assert (out.max(-1) - out.min(-1)).max() < 2
    plain = settings.preset_record("original")
    assert (raster.color(img, plain | {"invert": True}) == 255 - img).all()
    assert (raster.color(img, plain) == img).all()


def test_sizes():
    corners = [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert raster.target_size({"outSize": "a4"}, corners, 400, 300, np.inf) == (3508, 2480)
    assert raster.target_size({"outSize": "a4"}, None, 300, 400, np.inf) == (2480, 3508)
    assert raster.target_size({"outSize": "letter"}, None, 300, 400, np.inf) == (2550, 3300)
    assert max(raster.target_size({"outSize": "a4"}, None, 300, 400, 1000)) == 1000
    assert raster.target_size({}, None, 300, 400, np.inf) == (300, 400)


def test_turns_and_flips():
    img = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (raster.transform(img, 90)[:, 0] == img[1]).all()
    assert (raster.transform(raster.transform(img, 90), 270) == img).all()
    assert (raster.transform(img, flip_h=True) == img[:, ::-1]).all()
    assert raster.transform(np.zeros((100, 100, 3), dtype=np.uint8), straighten=45).shape[:2] == (141, 141)


def test_median_and_blocks():
    a = np.array([[9, 9, 9], [9, 9, 9], [0, 0, 0]], dtype=np.uint8)
    assert raster.median3(np.repeat(a[..., None], 3, axis=2), 100)[1, 1, 0] == 9
    ramp = np.tile(np.arange(20.0), (12, 1))
    assert np.allclose(raster.soft(ramp, 5), ramp, atol=1e-4)  # point reflection keeps a ramp


def test_largest_component_against_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(30):
        mask = rng.random((14, 17)) < 0.55
        seen, best = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask)):
            if not seen[y, x]:
                todo, part = [(y, x)], []
                seen[y, x] = True
                while todo:
                    p = todo.pop()
                    part.append(p)
                    for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
                        if 0 <= q[0] < 14 and 0 <= q[1] < 17 and mask[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
                if len(part) > len(best):
                    best = part
        want = np.zeros_like(mask)
        want[tuple(np.array(best).T)] = True
        assert (detect.largest_component(mask) == want).all()


def test_components_of_a_spiral(spark):
    """One path that winds inwards, far to the right of a wide image; two places beyond 4096 stay apart."""
    side, cells, (x, y), (dx, dy) = 41, set(), (0, 0), (1, 0)
    cells.add((0, 0))
    while True:
        ahead = (x + dx, y + dy)
        if 0 <= ahead[0] < side and 0 <= ahead[1] < side and (x + 2 * dx, y + 2 * dy) not in cells:
            x, y = ahead
            cells.add(ahead)
            continue
        dx, dy = -dy, dx
        if not (0 <= x + dx < side and 0 <= y + dy < side) or (x + 2 * dx, y + 2 * dy) in cells:
            break
    rows = [(1, 4600 + x, y, 1) for x, y in cells] + [(2, 4096, 0, 1), (2, 0, 1, 1)]
    out = {(r.image_id, r.x, r.y): r.label for r in neighbour.components(spark.createDataFrame(rows, "image_id int, x int, y int, v int")).collect()}
    assert len({v for (i, *_), v in out.items() if i == 1}) == 1 and len(cells) > 700
    assert out[2, 4096, 0] != out[2, 0, 1]


def test_hull_and_quad():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 50, (200, 2))
    h = geometry.hull(points)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        assert ((b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) >= 0).all()
    assert len(geometry.to_quad(h)) == 4
